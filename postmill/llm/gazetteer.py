"""Freely typed values mapped to the entries of a reference list.

Every value, read once per distinct text, is cut into its windows (runs of words that may be a name), and all windows
meet all phrases of the list in one set-similarity join: bigrams ordered by their rarity in the list, only the rare
prefix of each side joined, length, position and bitmap filters, Jaccard verified exactly, the best phrase of a window kept. A
name letter for letter is the case of similarity 1; below that a last check asks that a single slip of the pen lies
between. Names that entries share are told apart by the region or country beside them, which are phrases of the list
too. The list is a table like any other; nothing of it is collected.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.runtime import broadcast_if_small, materialize

#: Bigrams that one slip of the pen may cost a text: two neighbours that change places cost three.
LOST = 3
#: Texts of fewer bigrams (a letter less) are equal or not similar: codes are no words.
LEAST_GRAMS = 6
#: Usual short forms of words in names. Fixed values.
SHORT = {"st": "saint", "ste": "sainte", "mt": "mount", "ft": "fort", "n": "north", "s": "south", "e": "east", "w": "west", "pt": "port"}
_WORD = re.compile(r"[^\W_]+")
_STRONG = re.compile(r"[,;/|\n\r\t>:&()\[\]{}+•·]")


def plain(text: str) -> str:
    """Entities, percent signs and twice-encoded letters undone, accents off, lower case."""
    t = text
    if "&" in t:
        t = html.unescape(html.unescape(t))
    if "%" in t:
        t = unquote(t)
    if "Ã" in t or "Â" in t:
        for code in ("cp1252", "latin-1"):
            try:
                t = t.encode(code).decode("utf-8")
                break
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
    t = unicodedata.normalize("NFKD", t.replace("ß", "ss"))
    return "".join(c for c in t if not unicodedata.combining(c)).lower()


def words(text: str) -> tuple[list[str], list[bool]]:
    """The words of a plain text, short forms written out, and whether each is cut off from the one before."""
    out, cut, last = [], [], 0
    for m in _WORD.finditer(text):
        out.append(SHORT.get(m[0], m[0]))
        cut.append(bool(_STRONG.search(text, last, m.start())))
        last = m.end()
    return out, cut


class Reading:
    """What the phrases of the list say about the windows of one value."""

    def __init__(self, matches: list[dict]):
        self.names: dict[str, list[tuple]] = {}
        self.slips: dict[str, list[tuple]] = {}
        self.areas: dict[str, set] = {}
        self.heads, self.tails, self.vocabulary, self.area_words = set(), set(), set(), set()
        for m in matches:
            key = m["window"]
            entries = [(e["place_id"], e["region"], e["country"]) for e in m["names"]]
            if not m["exact"]:
                self.slips.setdefault(key, []).extend(entries)
                continue
            if entries:
                self.names[key] = entries
            if m["areas"]:
                self.areas[key] = {(x["kind"], x["said"]) for x in m["areas"]}
            for flag, at in (("head", self.heads), ("tail", self.tails), ("word", self.vocabulary), ("area_word", self.area_words)):
                if m[flag]:
                    at.add(key)

    def misspelt(self, w: list[str]) -> bool:
        """Whether exactly one of the words is in no name and no area: a slip of the pen is not another town."""
        strange = [x not in self.vocabulary and x not in self.area_words and len(x) > 1 and not x.isdigit() for x in w]
        return sum(strange) == 1 and all(s or x in self.vocabulary for x, s in zip(w, strange)) and sum(map(len, w)) >= 4

    def resolve(self, w: list[str], cut: list[bool], longest: int) -> list[int]:
        """Place ids that the words name; empty if none. The longest names first, names to the letter before slips."""
        n = len(w)
        spans: list[tuple[int, int, list[tuple]]] = []
        used = [False] * n

        def free(i: int, j: int) -> bool:
            return not any(used[i:j]) and not any(cut[i + 1 : j])

        def alone(i: int, j: int) -> bool:
            # a word like "saint" before or "bay" after makes it another town
            before = i > 0 and not cut[i] and w[i - 1] in self.heads and not used[i - 1]
            after = j < n and not cut[j] and w[j] in self.tails and not used[j]
            return not before and not after

        for known in (self.names, self.slips):
            if not known:
                continue
            for length in range(longest, 0, -1):
                for i in range(n - length + 1):
                    got = known.get(" ".join(w[i : i + length]))
                    if got and free(i, i + length) and alone(i, i + length) and (known is self.names or self.misspelt(w[i : i + length])):
                        spans.append((i, i + length, got))
                        used[i : i + length] = [True] * length
        if not spans:
            return []
        spans.sort(key=lambda x: x[:2])
        areas: list[tuple[int, set]] = []
        i = 0
        while i < n and self.areas:
            for length in range(min(longest, n - i), 0, -1):
                key = " ".join(w[i : i + length])
                if key in self.areas and not any(used[i : i + length]):
                    areas.append((i, self.areas[key]))
                    i += length - 1
                    break
            i += 1
        found: list[int] = []
        for k, (a, b, entries) in enumerate(spans):
            ids = {e[0]: e for e in entries}
            kept = sorted(ids)
            if len(ids) > 1:
                prev_end = spans[k - 1][1] if k else 0
                next_start = spans[k + 1][0] if k + 1 < len(spans) else n
                after = [x for at, x in areas if b <= at < next_start]
                before = [x for at, x in areas if prev_end <= at < a]
                kept = _tell_apart(ids, after) or _tell_apart(ids, before)
            found += [p for p in kept if p not in found]
        return found


def _tell_apart(ids: dict[int, tuple], near: list[set]) -> list[int]:
    said = set().union(*near) if near else set()
    score = {p: 2 * (("r", e[1]) in said) + (("c", e[2]) in said) for p, e in ids.items()}
    best = max(score.values())
    top = [p for p in score if score[p] == best]
    return top if best and len(top) == 1 else []


def one_slip(a: str, b: str) -> bool:
    """Whether one letter more, less, other, or two neighbours changed places lie between."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


def bigrams(text: str) -> list[str]:
    """Bigrams of a text with its ends marked; a repeated bigram carries its number."""
    t, seen, out = f"^{text}$", {}, []
    for i in range(len(t) - 1):
        g = t[i : i + 2]
        seen[g] = seen.get(g, 0) + 1
        out.append(f"{g}{seen[g]}")
    return out


def _with_grams(d: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bigrams(x) for x in b.column(0).to_pylist()], pa.list_(pa.string()))], ["text", "g"])

    return d.where(F.length("text") > 0).select("text").mapInArrow(run, "text string, g array<string>")


def _bound(m: Column) -> Column:
    """Least Jaccard similarity of bigram sets the larger of which has ``m``: what one slip of the pen leaves."""
    return F.when(m < LEAST_GRAMS, F.lit(1.0)).otherwise((m - LOST) / (m + LOST))


def similar(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right, similarity): pairs of ``left(text)`` and ``right(text)``, both distinct, whose numbers of bigrams
    differ by one at most and whose Jaccard similarity is at least (m - 3) / (m + 3), m being the larger number; below
    ``LEAST_GRAMS`` they are equal. Exact, by prefix filtering: such pairs have all but three bigrams in common, so one of
    the four rarest bigrams of each. Rarity is counted over ``right``; bigrams it has not come first, so a text that is like
    nothing there joins nothing.
    """
    most = right.agg(F.max(F.length("text"))).first()[0] or 0
    right, left = materialize(_with_grams(right), "grams"), _with_grams(left.where(F.length("text") <= most + 1))
    rank = materialize(right.select(F.explode("g").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f")), "rank")

    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(t), 64) as int))")

    def prefixed(d: DataFrame) -> DataFrame:
        each = d.select("text", F.explode("g").alias("t")).join(broadcast_if_small(rank, 100_000), "t", "left")
        o = each.groupBy("text").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "t"))).alias("o"), F.bit_or(bit).alias("bits"))
        o = o.select("text", F.col("o.t").alias("o"), F.col("o.f").alias("f"), F.size("o").alias("n"), "bits")
        keep = F.when(F.col("n") < LEAST_GRAMS - 1, 1).otherwise(LOST + 1)
        return o.select("text", "o", "n", "f", "bits", F.posexplode(F.slice("o", F.lit(1), keep)).alias("at", "t")).where(F.get("f", F.col("at")) > 0).drop("f")

    a = prefixed(left).select(F.col("text").alias("left"), F.col("o").alias("lo"), F.col("n").alias("ln"), F.col("bits").alias("lb"), F.col("at").alias("la"), "t")
    b = materialize(prefixed(right).select(F.col("text").alias("right"), F.col("o").alias("ro"), F.col("n").alias("rn"), F.col("bits").alias("rb"), F.col("at").alias("ra"), "t"), "prefix")
    larger = F.greatest("ln", "rn")
    need = F.when(larger < LEAST_GRAMS, larger).otherwise(larger - LOST)
    length = F.abs(F.col("ln") - F.col("rn")) <= 1
    # before this token at most min(la, ra) are shared, after it at most the shorter rest
    place = F.least("la", "ra") + F.least(F.col("ln") - F.col("la"), F.col("rn") - F.col("ra")) >= need
    # bits that one side alone has are bigrams that one side alone has: most pairs end here, before any array is read
    bitmap = F.bit_count(F.col("lb").bitwiseXOR(F.col("rb"))) <= F.col("ln") + F.col("rn") - 2 * need
    first = F.size(F.array_intersect(F.slice("lo", F.lit(1), F.col("la")), F.slice("ro", F.lit(1), F.col("ra")))) == 0  # each pair at its first common token
    shared = F.size(F.array_intersect("lo", "ro"))
    return (
        a.join(broadcast_if_small(b, 20_000), "t").where(length & place & bitmap & first)
        .select("left", "right", "ln", "rn", shared.alias("s"))
        .select("left", "right", (F.col("s") / (F.col("ln") + F.col("rn") - F.col("s"))).alias("similarity"), _bound(F.greatest("ln", "rn")).alias("bound"))
        .where("similarity >= bound - 1e-12").drop("bound")
    )


def phrases(entries: DataFrame) -> DataFrame:
    """(text, names, areas, head, tail, word, area_word): what each phrase of the list may mean.

    ``names`` are the entries it is a name of, ``areas`` the regions and countries; ``head`` and ``tail`` say that several
    names of more words begin or end with it, ``word`` and ``area_word`` that some name or area has it among its words.
    """
    names = ["text", "kind", "whole", "place_id", "region", "country"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for place_id, city, region, region_code, country, country_code, other in zip(*(c.to_pylist() for c in b.columns)):
                r, c = plain(region or ""), plain(country or "")
                for name in (city, other):
                    w = words(plain(name or ""))[0]
                    if w:
                        key = " ".join(w)
                        out.append((key, "n", key, place_id, r, c))
                        out += [(x, "v", key, None, None, None) for x in set(w)]
                        if len(w) > 1:
                            out += [(w[0], "h", key, None, None, None), (w[-1], "t", key, None, None, None)]
                for kind, value, said in (("r", region, r), ("r", region_code, r), ("c", country, c), ("c", country_code, c)):
                    w = words(plain(value or ""))[0]
                    if w:
                        out.append((" ".join(w), kind, said, None, None, None))
                        out += [(x, "a", said, None, None, None) for x in set(w)]
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 3 else pa.string()) for i, x in enumerate(cols)], names)

    src = entries.select(F.col("place_id").cast("int").alias("place_id"), "city", "region_name", "region_code", "country", "country_code", "other_name")
    each = src.mapInArrow(run, "text string, kind string, whole string, place_id int, region string, country string").distinct()
    is_ = lambda k: F.col("kind") == k
    return each.groupBy("text").agg(
        F.collect_set(F.when(is_("n"), F.struct("place_id", "region", "country"))).alias("names"),
        F.collect_set(F.when(F.col("kind").isin("r", "c"), F.struct("kind", F.col("whole").alias("said")))).alias("areas"),
        (F.count(F.when(is_("h"), 1)) > 1).alias("head"), (F.count(F.when(is_("t"), 1)) > 1).alias("tail"),
        F.max(is_("v")).alias("word"), F.max(is_("a")).alias("area_word"),
    )


def places_of(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(value, places, words): for each row of ``values(value)``, distinct and not blank, the listed places it names,
    [0] if none can be told, and its words in alphabetical order."""
    listed = materialize(phrases(entries), "phrases")
    size = listed.select(F.max(F.size(F.split("text", " "))).alias("w"), F.max(F.length("text")).alias("n")).first()
    longest, widest = size.w or 0, (size.n or 0) + 1  # a slip adds one letter at most

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, out, said = b.column(0), [], []
            for x in v.to_pylist():
                w, cut = words(plain(x))
                got = set()
                for i in range(len(w)):
                    text = ""
                    for j in range(i, min(len(w), i + longest)):
                        if j > i and cut[j]:
                            break
                        text = f"{text} {w[j]}" if text else w[j]
                        if len(text) > widest:
                            break
                        got.add(text)
                out.append(list(got))
                said.append(" ".join(sorted(w)))
            yield pa.RecordBatch.from_arrays([v, pa.array(out, pa.list_(pa.string())), pa.array(said, pa.string())], ["value", "windows", "words"])

    seen = values.select("value").mapInArrow(find, "value string, windows array<string>, words string")
    seen = materialize(seen.withColumn("row", F.monotonically_increasing_id()), "windows")
    each = seen.select("row", F.explode("windows").alias("window"))
    pairs = similar(each.select(F.col("window").alias("text")).distinct(), listed.select("text"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [x == y or (min(len(x), len(y)) > 3 and len(y) >= 5 and one_slip(x, y)) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield b.filter(pa.array(ok, pa.bool_()))

    good = materialize(pairs.mapInArrow(check, "left string, right string, similarity double"), "pairs")
    best = good.groupBy(F.col("left").alias("left")).agg(F.max("similarity").alias("most"))
    kept = good.join(best, "left").where("similarity >= most - 1e-9").select(F.col("left").alias("window"), F.col("right").alias("text"), (F.col("left") == F.col("right")).alias("exact"))
    meant = kept.join(listed, "text").where("exact or size(names) > 0").drop("text")
    got = each.join(broadcast_if_small(materialize(meant, "meant"), 20_000), "window")
    got = got.groupBy("row").agg(F.collect_list(F.struct("window", "exact", "names", "areas", "head", "tail", "word", "area_word")).alias("matches"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, out = b.column(0), []
            for x, m in zip(v.to_pylist(), b.column(1).to_pylist()):
                found = Reading(m).resolve(*words(plain(x)), longest) if m else []
                out.append(sorted(found) or [0])
            yield pa.RecordBatch.from_arrays([v, pa.array(out, pa.list_(pa.int32())), b.column(2)], ["value", "places", "words"])

    whole = seen.select("row", "value", "words").join(got, "row", "left").select("value", "matches", "words")
    return whole.mapInArrow(settle, "value string, places array<int>, words string")


def not_blank(c: Column) -> Column:
    return c.isNotNull() & c.rlike(r"(?U)[^\s\p{Z}]")


def map_values(rows: DataFrame, entries: DataFrame, *, key: str, value: str) -> DataFrame:
    """(key, place_id): one row per listed place that a non-blank value names; place_id 0 if it names none that can be
    told. NULL and blank values have no rows. Several places give several rows, each place once. Repeated rows are
    mapped each. Neither the list nor the values are bounded; an empty list leaves every value unmatched.
    """
    said = rows.where(not_blank(F.col(value))).select(F.col(key), F.col(value).alias("value"))
    mapped = places_of(materialize(said.select("value").distinct(), "values"), entries)
    return said.join(mapped, "value").select(key, F.explode("places").alias("place_id"))
