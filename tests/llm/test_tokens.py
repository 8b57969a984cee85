import base64
import os
import random

import pyarrow as pa
import pytest

from postmill.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.DEFAULT_VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_perfect_hash(reference):
    ranks = reference[1]
    t = T.encoder().table
    assert all(t.get(k) == v for k, v in ranks.items())
    assert t.n == len(ranks) == len(set(t.slot_key))
    assert t.get(b"surely not there at all") == -1 and t.get(b"") == -1


ODD = [
    "", " ", "  ", "\n\n", "a  b", "a   b ", "x\n y", "x\n\n y", " lead", "it's we'll I'D 'tis", " x　y", "tab\tx \t y", "日本語のテキスト", "é \U0001f600‍", "<|endoftext|>", " a",
    "aaaa" * 5000, "x" * 300 + " " * 300, "1234567890 " * 20, "\x85 \xa0a", "don't\r\n\r\nstop",
]


def test_batches_agree(reference):
    enc, rng = T.encoder(), random.Random(5)
    al = " \n\t\r\xa0 　aAbé1٣'.!的😀​\x1c\x85s"
    texts = ODD + ["".join(rng.choice(al) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    ids, at = enc.batch(pa.array([*texts, None]))
    assert at[-1] == at[-2]
    n = enc.counts(pa.array([*texts, None]))
    for i, t in enumerate(texts):
        want = reference[0].encode_ordinary(t)
        assert ids[at[i] : at[i + 1]].tolist() == want == enc.encode(t), repr(t[:50])
        assert n[i] == len(want)


def test_frames(spark, reference):
    rows = [(1, None, "k"), (2, "", "k"), (3, "two words", "k"), (3, "two words", "k"), (4, "z" * 3_000_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, tuple(r.ids)) for r in T.encode(df, "doc_id", "text").collect())
    assert got[:4] == [(1, ()), (2, ()), (3, tuple(reference[0].encode_ordinary("two words")))] + [got[3]] and got[2] == got[3]
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0
    c = {r.doc_id: r.n_tokens for r in T.token_counts(df, "text").collect()}
    assert c[1] == c[2] == 0 and c[3] == 2 and c[4] == len(got[4][1])
