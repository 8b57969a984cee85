import os
import random
import re

import pytest

from postmill.llm import splitting as S
from postmill.llm.tokens import DEFAULT_VOCABULARY, encoder

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary")
LIMITS = [("a", "byte_bpe_50k", 128, 16), ("b", "byte_bpe_50k", 512, 64), ("plain", "byte_bpe_50k", 300, 0)]


def texts():
    rng = random.Random(9)
    w = lambda: rng.choice(["alpha", "Bravo", "it's", "e.g.", "über", "12.5", "(see", "x)", "日本", "end.", "Next!"])
    para = lambda k: " ".join(w() for _ in range(k))
    out = [None, "", " ", "short", "one\n\ntwo", "\n" * 50, "   lead  and   double   spaces  " * 40]
    out += ["\n\n".join(para(rng.randint(5, 60)) for _ in range(30)), "\n".join("- " + para(12) for _ in range(120)), " ".join(para(9) + "." for _ in range(150))]
    out += ["".join(rng.choice("abcdefXYZ0189+/") for _ in range(6000)), "字" * 3000, "a" * 5000, "😀" * 1500, "tab\t" * 3000, "x \n " * 900, "\r\n\r\n".join(para(20) for _ in range(80))]
    out += ["\n\n".join(para(rng.randint(5, 90)) for _ in range(700)), "".join(rng.choice("abcdef 019") for _ in range(120_000)), "q" * 100_000]
    return out


@pytest.fixture(scope="module")
def made(spark):
    t = texts()
    docs = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(t)], "doc_id long, text string, limit_name string, n_tokens int")
    limits = spark.createDataFrame(LIMITS, "limit_name string, tokenizer string, max_tokens int, overlap_tokens int")
    found = S.pieces(docs, limits).cache()
    return t, found.collect(), S.texts(found, docs).collect()


def test_pieces(made):
    t, rows, with_text = made
    enc = encoder()
    lim = {r[0]: r[2:] for r in LIMITS}
    by = {}
    for r in rows:
        by.setdefault((r.limit_name, r.doc_id), []).append(r)
    assert set(by) == {(n, i) for n in lim for i, x in enumerate(t) if x}
    for (name, doc), v in by.items():
        v.sort(key=lambda r: r.piece_no)
        most, overlap = lim[name]
        assert [r.piece_no for r in v] == list(range(1, len(v) + 1))
        assert v[0].start_char == 0 and v[-1].end_char == len(t[doc])
        for a, b in zip(v, v[1:]):
            assert a.start_char < b.start_char <= a.end_char < b.end_char  # nothing lost, all go forward
            assert 0 <= b.overlap_tokens <= overlap and (overlap or b.start_char == a.end_char)
        sizes = [len(enc.encode(t[doc][r.start_char : r.end_char])) for r in v]
        assert max(sizes) <= most, (name, doc, max(sizes))
        if len(enc.encode(t[doc])) <= most:
            assert len(v) == 1
        if not any(len(enc.encode(u)) > S.MOST_IDS for u in re.findall(r" ?\S+\s*|^\s+", t[doc])):  # no unit is cut inside
            assert sizes == [r.n_tokens for r in v], (name, doc)
    assert all(r.text == t[r.doc_id][r.start_char : r.end_char] for r in with_text)


def test_ranges_give_what_the_whole_gives(spark, monkeypatch, tmp_path):
    """The same pieces, with the same numbers of ids, whether texts are read whole, in small ranges, or as files."""
    t = [x for x in texts() if x] + ["y" * 9000 + " \n\n " * 900 + "Ende. (next) z" * 50, "é" * 5000 + "x", " " * 5000 + "a b"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(t)] + [(0, t[0])], "doc_id long, text string")
    limits = spark.createDataFrame(LIMITS, "limit_name string, tokenizer string, max_tokens int, overlap_tokens int")
    rows = lambda df, k="doc_id": sorted((str(r[k]), *(r[c] for c in ("limit_name", "piece_no", "start_char", "end_char", "n_tokens", "overlap_tokens", "boundary"))) for r in df.collect())
    monkeypatch.setattr(S, "RANGE", 10**9)
    want = rows(S.pieces(docs, limits))
    (tmp_path / "a.txt").write_text(t[15] * 3, newline="")
    monkeypatch.setattr(S, "RANGE", 9_000)
    got = rows(S.pieces(docs, limits))
    assert len(got) == len(want)
    assert [x for x in got if x not in set(want)] == []
    one = rows(S.pieces(spark.createDataFrame([("f", t[15] * 3)], "doc_id string, text string"), limits))
    assert [x[1:] for x in rows(S.pieces_of_files(spark, [f"file://{tmp_path}/a.txt"], limits), "path")] == [x[1:] for x in one] and len(one) > 3


def test_natural_boundaries(made):
    t, rows, _ = made
    para = [r for r in rows if r.doc_id == 7 and r.limit_name == "b"]
    assert len(para) > 2 and all(r.boundary == "paragraph" for r in para)
    assert all(t[7][r.end_char - 2 : r.end_char] == "\n\n" for r in para if r.end_char < len(t[7]))
    lines = [r for r in rows if r.doc_id == 8 and r.limit_name == "b"]
    assert all(r.boundary in ("line", "paragraph") for r in lines)
    assert any(r.boundary == "inside a word" for r in rows if r.doc_id == 12)


def test_overlap_is_used(made):
    got = [r.overlap_tokens for r in made[1] if r.limit_name == "b" and r.doc_id == 17 and r.piece_no > 1]
    assert got and sum(got) / len(got) > 48


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    limits = spark.createDataFrame(LIMITS, "limit_name string, tokenizer string, max_tokens int, overlap_tokens int")
    assert S.pieces(docs, limits).count() == 0
    assert S.pieces(spark.createDataFrame([(1, "x")], "doc_id long, text string"), limits.limit(0)).count() == 0


def test_more_limits_than_are_read_are_refused(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    limits = spark.range(1001).selectExpr("concat('l', id) AS limit_name", "'t' AS tokenizer", "100 AS max_tokens", "0 AS overlap_tokens")
    with pytest.raises(ValueError):
        S.pieces(docs, limits)


def test_texts_are_made_for_all_limits(spark, sf):
    from postmill.llm import queries as Q

    assert {r[0] for r in Q.p10_texts(spark, sf).select("limit_name").distinct().collect()} == {r[0] for r in Q.load(spark, sf, "split_limits").select("limit_name").collect()}
