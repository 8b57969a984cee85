import itertools
import random

import pytest

from postmill.llm import gazetteer as G

PLACES = [
    (1, "Saint Brünhaven", "Old Delmoor", "OLD", "Meridia Isles", "MIS", "x", "Port Nunuluda"), (2, "Kestrelholm", "Upper Delmoor", "UPD", "Valdoria", "VDR", "x", None),
    (3, "Kestrelholm", "East Gollard", "EGO", "Tarn Republic", "TRN", "x", "LHBN"), (4, "Anságate", "Lower Gollard", "LOG", "Corvane", "CVN", "x", None),
    (5, "Anságate-on-Sea", "West Gollard", "WGO", "Ostrelle", "OSL", "x", None), (6, "Fort Mirelbury", "West Gollard", "WGO", "Ostrelle", "OSL", "x", None), (7, "Fort Wexel", "Old Delmoor", "OLD", "Meridia Isles", "MIS", "x", None),
]
SCHEMA = "place_id int, city string, region_name string, region_code string, country string, country_code string, full_name string, other_name string"
CASES = {
    "St. Brünhaven, OLD": [1], "SAINT BRUNHAVEN": [1], "Saint BrÃ¼nhaven": [1], "Saint Br&#252;nhaven,&nbsp;Old Delmoor": [1], "Saint%20Brünhaven,%20MIS": [1], "port nunuluda!": [1],
    "Kestrelholm": [0], "Kestrelholm, UPD": [2], "Tarn Republic > East Gollard > Kestrelholm": [3], "Kestrelholm (Valdoria) / Kestrelholm, EGO": [2, 3], "lhbn": [3], "Kestrelholm, Corvane": [0],
    "Anságate-on-Sea": [5], "ansagate, LOG J8J 3H2": [4], "Anságtae": [4], "Remote - Anságate / Hybrid": [4], "Fort Mirelburyy": [6], "Mirelbury": [0], "Fort Kestrelholm, UPD": [0], "Remote": [0], "Valdoria": [0],
    "Anságate Bay": [4], "Fort Mirelbury_West Gollard": [6], "WGO.Fort-Mirelbury": [6], "Nowhere; Anságate or Fort Mirelbury": [4, 6], "x" * 50_000: [0], "!!!": [0],
}


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(PLACES, SCHEMA)


def test_values(spark, places):
    rows = [(i, v, "clash") for i, v in enumerate(CASES)] + [(900, None, ""), (901, "", ""), (902, "  ", ""), (903, "Anságate", ""), (903, "Anságate", "")]
    df = spark.createDataFrame(rows, "id long, location string, value string")
    got = {}
    for r in G.map_values(df, places, key="id", value="location").collect():
        got.setdefault(r.id, []).append(r.place_id)
    for i, (v, want) in enumerate(CASES.items()):
        assert sorted(got[i]) == want, v
    assert not {900, 901, 902} & set(got) and got[903] == [4, 4]
    assert G.map_values(df.limit(0), places, key="id", value="location").count() == 0
    assert {r.place_id for r in G.map_values(df.where("id < 5"), places.limit(0), key="id", value="location").collect()} == {0}


def grams(t):
    t = f"^{t}$"
    seen, out = {}, set()
    for a, b in zip(t, t[1:]):
        seen[a + b] = seen.get(a + b, 0) + 1
        out.add(f"{a}{b}{seen[a + b]}")
    return out


def near(a, b):
    m = max(len(grams(a)), len(grams(b)))
    bound = (m - 3) / (m + 3) if m >= 6 else 1.0
    return abs(len(grams(a)) - len(grams(b))) <= 1 and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= bound - 1e-12


def test_similarity_join_is_exact(spark):
    rng = random.Random(1)
    words = list({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    words += [w[:3] + w[4] + w[3] + w[5:] for w in words if len(w) > 5]
    words = list(dict.fromkeys(words))
    left, right = words[:320], words[60:]
    want = {(a, b) for a, b in itertools.product(left, right) if near(a, b)}
    df = lambda x: spark.createDataFrame([(w,) for w in x], "text string")
    got = [(r.left, r.right) for r in G.similar(df(left), df(right)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(set(left) & set(right)) + 50


def test_every_slip_is_similar():
    for w in ("paris", "pariss", "anna-marie", "aabbaabb", "qqqqqqq"):
        for i in range(len(w)):
            ways = [w[:i] + w[i + 1 :], w[:i] + "x" + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]]
            assert all(near(x, w) for x in ways if max(len(grams(x)), len(grams(w))) >= 6), w


def test_short_names_with_a_slip(spark):
    places = spark.createDataFrame([(1, "Paris", "R", "RR", "C", "CC", "x", None), (2, "Bonn", "R", "RR", "C", "CC", "x", None)], SCHEMA)
    rows = spark.createDataFrame([(1, "Pairs"), (2, "Prais, RR"), (3, "Bnon"), (4, "Bonn"), (5, "Pari")], "id long, location string")
    assert {r.id: r.place_id for r in G.map_values(rows, places, key="id", value="location").collect()} == {1: 1, 2: 1, 3: 0, 4: 2, 5: 1}


def test_a_long_list_is_no_matter(spark):
    """More entries than any worker is given: the list is joined, not collected."""
    many = spark.range(250_000).selectExpr("cast(id as int) AS place_id", "concat('town', conv(id, 10, 26)) AS city", "'R' AS region_name", "'RR' AS region_code", "'C' AS country", "'CC' AS country_code", "'' AS full_name", "cast(null as string) AS other_name")
    rows = spark.createDataFrame([(1, "Town8E"), (2, "remote; TOWN1A2B"), (3, "nowhere")], "id long, location string")
    got = {r.id: r.place_id for r in G.map_values(rows, many, key="id", value="location").collect()}
    assert got == {1: int("8E".lower(), 26), 2: int("1a2b", 26), 3: 0}


def test_one_slip():
    for a, b, ok in (("abc", "abc", 1), ("abc", "abd", 1), ("abc", "acb", 1), ("abc", "ab", 1), ("abc", "abcd", 1), ("abcd", "badc", 0), ("abc", "xyz", 0), ("", "a", 1), ("", "ab", 0)):
        assert G.one_slip(a, b) == bool(ok) == G.one_slip(b, a)
