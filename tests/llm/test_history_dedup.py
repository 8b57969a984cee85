import uuid

import pytest

from postmill.llm import history_dedup as H
from postmill.runtime import shared_dir
from tests.llm.test_gazetteer import PLACES, SCHEMA

COLS = "id long, batch_no int, company_name string, title string, location string, job_url string, source_name string, external_job_id string"
FILL = [(1000 + i, 0, "Filler", t, None, None, "f", None) for i, t in enumerate(["Senior Data Engineer Harbor", "Principal Warehouse Analyst", "Junior Reliability Planner"] * 25)]
ROWS = [
    (1, 0, "Acme & Sons", "Senior Data Engineer (Harbor)", "Anságate, LOG", "https://h.example/en/jobs/4000000001/senior-data", "s1", "4000000001"),
    (2, 0, "Acme & Sons", "Senior Data Engineer (Harbor), Level 2", "Anságate, LOG", None, "s1", None),
    (3, 1, " ACME & SONS", "harbor: Sr. Data Enginer", "Corvane > Lower Gollard > Ansagate", None, "s2", None),  # title, place, company
    (4, 1, "Other", "Something else", "Remote", "http://www.H.example/job?pid=4000000001&utm_source=x#top", "s9", None),  # address
    (5, 1, "Acme & Sons", "Quite different", None, None, "s1", " 4000000001\t"),  # id on the source
    (6, 2, "Acme & Sons", "Quite different", None, None, "s2", "4000000001"),  # repeats 5 by title
    (7, 2, "Acme & Sons", "Senior Data Engineer (Harbor)", "Kestrelholm, UPD", None, "s3", None),  # another place
    (8, 2, "Acme & Sons", "Junior Data Engineer (Harbor)", "Anságate", None, "s3", None),  # another level
    (9, 3, "Acme & Sons", "Senior Data Engineer (Harbor), Level 3", "Anságate", None, "s3", None),  # another number
    (10, 3, None, None, None, None, None, None), (11, 3, None, None, None, None, None, None), (12, 3, "", "", "", "", "", ""),
    (13, 3, "Acme & Sons", "Senior Data Engineer (Harbor), Level 2", "ANSÁGATE", "https://h.example/openings/x-4000000002/", "s4", None),
]
WANT = {3: 1, 4: 1, 5: 1, 6: 5, 13: 2}


def canonical(spark, rows):
    places = spark.createDataFrame(PLACES, SCHEMA)
    df = spark.createDataFrame(rows, COLS)
    return H.canonical(df, places).join(df.select("id", "batch_no"), "id").cache()


def history(spark):
    return H.History(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}")


def taken(spark, rows):
    c = canonical(spark, rows)
    h = history(spark)
    h.append(c.where("batch_no = 0"))
    return {r.id: r.accepted_id for r in h.take(c.where("batch_no > 0")).collect()}, h


def test_one_delivery(spark):
    assert taken(spark, FILL + ROWS)[0] == WANT


def test_batches_are_read_alone(spark):
    places, df = spark.createDataFrame(PLACES, SCHEMA), spark.createDataFrame(FILL + ROWS, COLS)
    h, got = history(spark), {}
    for b in (0, 1, 2, 3):
        c = H.canonical(df.where(f"batch_no = {b}"), places)
        if b:
            got |= {r.id: r.accepted_id for r in H.History(spark, h.path).take(c).collect()}
        else:
            h.append(c)
    assert got == WANT


def test_hot_group_and_empty_batch(spark):
    rows = FILL + [(i, 0 if i < 5 else 1, "Acme", "Senior Data Engineer Harbor", "Remote", None, "s", "same") for i in range(1, 400)]
    c = canonical(spark, rows)
    h = history(spark)
    h.append(c.where("batch_no = 0"))
    assert h.take(c.limit(0)).count() == 0
    before = h.keys().count(), h.titles().count()
    got = h.take(c.where("batch_no = 1")).collect()
    assert len(got) == 395 and {r.accepted_id for r in got} == {1}
    assert (h.keys().count(), h.titles().count()) == before  # nothing new, nothing appended


def test_empty_history(spark):
    c = canonical(spark, [(1, 1, "Acme", "Senior Data Engineer", "Remote", None, "s", "x1"), (2, 1, "Acme", "Senior Data Engineer", "Remote", None, "s", None)])
    assert {r.id: r.accepted_id for r in history(spark).take(c).collect()} == {2: 1}


def test_a_slip_in_a_rare_word(spark):
    rows = [(1, 0, "Acme", "Zanzibar Quokka Wrangler", "Remote", None, "s", None), (2, 1, "Acme", "Zanzibar Quoka Wrangler", "Remote", None, "s", None), (3, 1, "Acme", "Zanzibar Emu Wrangler", "Remote", None, "s", None)]
    assert taken(spark, rows)[0] == {2: 1}


def test_small_batch_reads_its_partitions_only(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET_ROWS", 64)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lm", "rn", "st", "nt", "ck", "sh")]
    rows = [(i, 0, f"Firm {i}", f"{w} wrangler {words[-i]}", "Remote", None, "s", f"x{i}") for i, w in enumerate(words, 1)]
    c = canonical(spark, rows + [(9000, 1, "Firm 7", rows[6][3], "Remote", None, "other", None)])
    h = history(spark)
    h.append(c.where("batch_no = 0"))
    folder, buckets = h._state()
    assert buckets >= 32
    asked = []
    real = h._matching
    monkeypatch.setattr(h, "_matching", lambda name, schema, key, wanted: asked.append(wanted.select(h._bucket(key, buckets)).distinct().count()) or real(name, schema, key, wanted))
    assert {r.id: r.accepted_id for r in h.take(c.where("batch_no = 1")).collect()} == {9000: 7}
    assert max(asked) <= 2 * H.BANDS < buckets  # a band each, and single ones of a short title
    before = sorted(map(tuple, h.keys().collect())), h.titles().count()
    monkeypatch.setattr(H, "BUCKET_ROWS", 256)
    h.compact()
    assert h._state()[1] < buckets and (sorted(map(tuple, h.keys().collect())), h.titles().count()) == before


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("https://h.example/postings/JR-55", "HTTP://WWW.h.example/postings/JR-55/?ref=share#x", True), ("https://h.example/fr/jobs/R_0000000012/un-titre", "https://h.example/en/jobs/R_0000000012/a-title", True),
        ("https://h.example/postings/JR-55", "https://h.example/postings/JR-56", False), ("https://h.example/postings/JR-55", "https://g.example/postings/JR-55", False),
        ("https://h.example/job?lang=en&pid=a81a838a-4e98-4f67-5836-00cca2c1a550", "https://h.example/job?pid=A81A838A-4e98-4f67-5836-00cca2c1a550&lang=fr", True), ("https://h.example/about?b=1&a=2", "https://h.example/about/?a=2&b=1", True),
    ],
)
def test_posting_page(a, b, same):
    assert (H.posting_page(a) == H.posting_page(b)) is same
    assert H.posting_page(None) is H.posting_page("  ") is None and H.posting_page("http://[broken") is None


def test_slips_are_found_however_often_they_are_repeated(spark):
    right, slip = "Senior Interim Wrangler", "Senior Inteim Wrangler"
    rows = [(i, 0, "Acme", right, "Remote", None, "s", None) for i in range(1, 101)] + [(200 + i, 1, "Acme", slip, "Remote", None, "s", None) for i in range(40)]
    rows += [(300 + i, 0, f"Firm {i}", right, "Remote", None, "s", None) for i in range(2)]
    rows += [(400 + i, 1, f"Firm {i}", "Senior Inteaim Wrangler", "Remote", None, "s", None) for i in range(2)]
    rows += [(500, 0, "Acme", "Data Data Steward", "Remote", None, "s", None), (501, 1, "Acme", "Dat Data Steward", "Remote", None, "s", None)]
    rows += [(502, 0, "Acme", "Data Steward Level 3", "Remote", None, "s", None), (503, 1, "Acme", "Data Steward Level 4", "Remote", None, "s", None)]
    rows += [(504, 0, "Acme", "Steward Grade VIII", "Remote", None, "s", None), (505, 1, "Acme", "Steward Grade VII", "Remote", None, "s", None)]
    assert taken(spark, rows)[0] == {**{200 + i: 1 for i in range(40)}, 400: 300, 401: 301, 501: 500}


def slips(w):
    return {x for x in (w[:2] + w[3:], w[:2] + "x" + w[2:], w[:2] + "x" + w[3:], w[:2] + w[3] + w[2] + w[4:]) if x != w}


def test_every_slip_meets(spark):
    """Titles of one to six words, each word misspelt in turn, in each way; and slips in two words at once."""
    words = "quarterly zanzibar quokka wrangling marble lantern".split()
    rows, want = [], {}
    for n in range(1, 7):
        for i in range(n):
            for x in sorted(slips(words[i])):
                j = len(rows)
                rows += [(j, 0, f"Firm {j}", " ".join(words[:n]), "Remote", None, "s", None), (j + 1, 1, f"Firm {j}", " ".join([*words[:i], x, *words[i + 1 : n]]), "Remote", None, "s", None)]
                want[j + 1] = j
    j = len(rows)
    rows += [(j, 0, "Firm", " ".join(words), "Remote", None, "s", None), (j + 1, 1, "Firm", " ".join(["quaterly", "zanzibra", *words[2:]]), "Remote", None, "s", None)]
    assert taken(spark, rows)[0] == {**want, j + 1: j}


def test_bands_miss_what_the_similarity_says():
    """Shares of pairs that share no band, against (1 - s^r)^b, over many titles."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    titles = [" ".join(word() for _ in range(3)) for _ in range(4000)]
    bad = [" ".join([*t.split()[:2], t.split()[2][:1] + t.split()[2][2] + t.split()[2][1] + t.split()[2][3:]]) for t in titles]
    (a, n), (b, m) = H.minwise(titles), H.minwise(bad)
    x, y = H.bands_of(a, n <= H.FEW), H.bands_of(b, m <= H.FEW)
    assert sum(not set(p) & set(q) for p, q in zip(x, y)) <= 2
    equal = (a == b).mean()
    true = sum(len(H.grams(s) & H.grams(t)) / len(H.grams(s) | H.grams(t)) for s, t in zip(titles, bad)) / len(titles)
    assert abs(equal - true) < 0.02


def test_queries_agree(spark, sf):
    from postmill.llm import queries as Q

    found, each = Q.p1_found(spark, sf).collect(), Q.p1_batches(spark, sf).collect()
    assert len(found) == sum(r.repeats for r in each) == sum(r.by_id + r.by_page + r.by_title + r.by_slip for r in each)
