"""New batches against everything accepted before, without working through the history again.

A posting is known by sets, each within a scope: its id on its source and the page its address leads to are sets of one
element, its title is the set of the bigrams of its words within company and place. Minwise hashing gives a set its band
keys: equal sets share all of them, similar sets some. The keys are kept in a table partitioned by their high bits, the
titles with their signatures in another; a batch reads the partitions its own keys fall into, and of those only the
rows with one of its keys, before anything is shuffled or aggregated. What meets is verified: ids and addresses by
their full text, titles by their signatures, then word for word, each pair once. Then what is not known yet is appended. Nothing depends on other rows, so batches one after another find what one large batch finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.gazetteer import not_blank, one_slip, places_of, plain
from postmill.runtime import broadcast_if_small, materialize

#: Short forms of words in titles, unless others are given. Fixed values of usage.
SHORT = {
    "sr": "senior", "snr": "senior", "jr": "junior", "jnr": "junior", "assoc": "associate", "princ": "principal", "grad": "graduate",
    "mgr": "manager", "eng": "engineer", "engr": "engineer", "dev": "developer", "tech": "technician", "spec": "specialist",
    "supv": "supervisor", "coord": "coordinator", "admin": "administrator", "anlst": "analyst", "arch": "architect", "cons": "consultant",
    "ops": "operations", "db": "database", "infra": "infrastructure", "mktg": "marketing", "qa": "quality",
}
#: Parameters of addresses that say where a reader came from, whole names and beginnings. Fixed values of usage.
TRACKING = ("ref", "src", "source", "gclid", "fbclid", "trk", "lang", "locale", "hl")
TRACKING_PREFIX = ("utm_",)
_ID = re.compile(r"(?:^|[-_/])([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[a-z]{1,3}[-_]\d{2,}|\d{5,}|[0-9a-f]{12,40})$")
_WORD = re.compile(r"[^\W_]+")
_ROMAN = re.compile(r"[ivxlcdm]+\Z")
#: Bands of a signature and minima in each. A slip costs a title of 24 bigrams three of them at most: a similarity of 0.78,
#: at which all bands are missed once in 40,000 titles; in a title of 36 bigrams once in 4 million.
BANDS, ROWS = 16, 3
#: Titles of so few bigrams also have a band for each single minimum of a third of the signature.
FEW = 26
#: Words of two titles that a slip may tell apart, and the similarity that leaves at least.
MOST_SLIPS, LEAST_SIMILAR = 2, 0.25
#: Of the 48 bytes of two signatures, so many are equal at least; at the similarity of 0.5 fewer are once in ten million pairs.
LEAST_EQUAL = 6
#: Keys a partition of the history is made for.
BUCKET_ROWS = 200_000
_KEYS = "kind tinyint, key bigint, proof string, tid bigint, id bigint"
_TITLES = "tid bigint, proof string, words string, sig binary, id bigint"
_SEEDS = np.random.RandomState(7).randint(1, 2**63 - 1, size=(2, BANDS * ROWS), dtype=np.int64).astype(np.uint64)
_SEEDS[0] |= np.uint64(1)


def posting_page(url: str | None) -> str | None:
    """Host and id of the posting an address leads to; without an id the address less scheme, tracking and fragment.

    NULL, blank and unreadable addresses give NULL. Language, slug, letter case and the way to the page don't matter.
    """
    if not url or not url.strip():
        return None
    try:
        p = urlsplit(url.strip().lower())
    except ValueError:
        return None
    host = (p.netloc or "").split("@")[-1].removesuffix(":443").removesuffix(":80").removeprefix("www.")
    params = [(k, v) for k, v in parse_qsl(p.query) if k not in TRACKING and not k.startswith(TRACKING_PREFIX)]
    for k, v in params:
        if k in ("pid", "id", "jobid", "job_id", "gh_jid", "jid", "postingid") and v:
            return f"{host} {v}"
    segments = [s for s in p.path.split("/") if s]
    for s in reversed(segments):
        m = _ID.search(s)
        if m:
            return f"{host} {m[1]}"
    if not host and not segments:
        return None
    return f"{host}/{'/'.join(segments)}?{'&'.join(f'{k}={v}' for k, v in sorted(params))}"


def read(rows: DataFrame, short: dict[str, str] | None = None) -> DataFrame:
    """``rows(id, company_name, title, location, job_url, source_name, external_job_id)`` with their plain forms."""
    names = ["id", "location", "ext", "page", "company", "words"]
    forms = SHORT if short is None else short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            company, title, url, source, ext = (b.column(i).to_pylist() for i in range(2, 7))
            cols = [
                [f"{s} {e.strip().lower()}" if s is not None and e and e.strip() else None for s, e in zip(source, ext)],
                [posting_page(u) for u in url],
                [" ".join(_WORD.findall(plain(c))) if c else None for c in company],
            ]
            cols.append([" ".join(sorted(forms.get(w, w) for w in _WORD.findall(plain(t)))) or None if t else None for t in title])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.string()) for c in cols]], names)

    src = rows.select(F.col("id").cast("bigint").alias("id"), "location", "company_name", "title", "job_url", "source_name", "external_job_id")
    return src.mapInArrow(run, "id bigint, location string, ext string, page string, company string, words string")


def canonical(rows: DataFrame, places: DataFrame, short: dict[str, str] | None = None) -> DataFrame:
    """(id, ext, page, company, place, place_words, words): what a posting is compared by, each row by itself.

    ``words`` are those of the title in alphabetical order, short forms (``short``, else ``SHORT``) written out; NULL if it
    has none. ``place`` are the listed places its location names, NULL if none; ``place_words`` the location's words.
    """
    plain_rows = materialize(read(rows, short), "plain")
    said = plain_rows.where(not_blank(F.col("location"))).select(F.col("location").alias("value")).distinct()
    place = places_of(materialize(said, "values"), places).select(
        F.col("value").alias("location"), F.when(F.col("places")[0] != 0, F.array_join("places", ",")).alias("place"), F.col("words").alias("place_words")
    )
    out = plain_rows.join(place, "location", "left")
    return out.select("id", "ext", "page", "company", "place", F.coalesce("place_words", F.lit("")).alias("place_words"), "words")


def _wheres() -> Column:
    """The forms in which a place is compared: the listed places, and the words where these may say more."""
    many = F.size(F.split("place_words", " ")) >= 6
    by_words = F.when(F.col("place").isNull() | many, F.concat(F.lit("w "), "place_words"))
    return F.array_compact(F.array(F.concat(F.lit("p "), "place"), by_words))


def grams(words: str) -> set[str]:
    """Bigrams of the words of a title, their ends marked."""
    return {w[i : i + 2] for x in words.split(" ") for w in (f"^{x}$",) for i in range(len(w) - 1)}


def minwise(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, numbers of bigrams) of titles, each of one word or more: the low bytes of BANDS * ROWS minima."""
    sets = [grams(t) for t in titles]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    memo: dict[str, int] = {}

    def h(g: str) -> int:
        got = memo.get(g)
        if got is None:
            got = memo[g] = xxhash.xxh64_intdigest(g)
        return got

    flat = np.fromiter((h(g) for x in sets for g in x), np.uint64, int(n.sum()))
    starts = np.concatenate([[0], np.cumsum(n)])[:-1]
    sig = np.empty((len(sets), BANDS * ROWS), np.uint8)
    for i in range(BANDS * ROWS):
        v = flat * _SEEDS[0, i] + _SEEDS[1, i]
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)  # a known constant of 64-bit mixing
        v ^= v >> np.uint64(32)
        sig[:, i] = (np.minimum.reduceat(v, starts) & np.uint64(255)).astype(np.uint8)
    return sig, n


def bands_of(sig: np.ndarray, few: np.ndarray) -> list[list[int]]:
    """The bands of signatures as numbers: ROWS bytes together, and single bytes of titles with few bigrams."""
    wide = sig.reshape(len(sig), BANDS, ROWS).astype(np.int64)
    packed = sum(wide[:, :, r] << (8 * r) for r in range(ROWS)) + (np.arange(BANDS, dtype=np.int64) << 32)
    single = sig[:, :BANDS].astype(np.int64) + (np.arange(BANDS, 2 * BANDS, dtype=np.int64) << 32)
    return [[*p, *s] if f else p for p, s, f in zip(packed.tolist(), single.tolist(), few.tolist())]


def titles(c: DataFrame) -> DataFrame:
    """(tid, proof, words, sig, bands, id, last): one row per company, place and title that differ, with the smallest and
    the largest id, aggregated before anything is hashed, so copies without end are one row."""
    t = c.where(F.col("company").isNotNull() & F.col("words").isNotNull()).select("id", "company", "words", F.explode(_wheres()).alias("place"))
    t = t.groupBy(F.concat_ws(" @ ", "company", "place").alias("proof"), "words").agg(F.min("id").alias("id"), F.max("id").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig, n = minwise(b.column(1).to_pylist())
                bytes_ = pa.array([x.tobytes() for x in sig], pa.binary())
                bands = pa.array(bands_of(sig, n <= FEW), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*b.columns, bytes_, bands], ["proof", "words", "id", "last", "sig", "bands"])

    out = t.mapInArrow(run, "proof string, words string, id bigint, last bigint, sig binary, bands array<bigint>")
    return out.select(F.xxhash64("proof", "words").alias("tid"), "proof", "words", "sig", "bands", "id", "last")


def simple_keys(c: DataFrame) -> DataFrame:
    """Keys of the sets of one element: kind 0 the id on its source, 1 the page; the smallest id of each."""
    pairs = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("ext").alias("proof")), F.struct(F.lit(1).alias("kind"), F.col("page").alias("proof"))))
    x = c.select("id", pairs.alias("x")).where("x.proof is not null")
    x = x.groupBy(F.col("x.kind").cast("tinyint").alias("kind"), F.col("x.proof").alias("proof")).agg(F.min("id").alias("id"))
    return x.select("kind", F.xxhash64("kind", "proof").alias("key"), "proof", F.lit(None).cast("bigint").alias("tid"), "id")


def band_keys(t: DataFrame) -> DataFrame:
    """Keys of the bands of ``titles``, kind 2: a band within its company and place."""
    none = F.lit(None).cast("string").alias("proof")
    each = t.select("tid", "proof", "id", F.explode("bands").alias("band"))
    return each.select(F.lit(2).cast("tinyint").alias("kind"), F.xxhash64(F.lit(-2), "proof", "band").alias("key"), none, "tid", "id")


def same_title(a: str, b: str) -> bool:
    """Whether two titles are the same word for word, but for slips of the pen in MOST_SLIPS words at most."""
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y):
        return False
    for w in list(x):
        if w in y:
            x.remove(w)
            y.remove(w)
    if len(x) > MOST_SLIPS:
        return False
    for u in x:
        for v in y:
            if max(len(u), len(v)) >= 4 and min(len(u), len(v)) >= 3 and one_slip(u, v) and not re.search(r"\d", u + v) and not (_ROMAN.match(u) and _ROMAN.match(v)):
                y.remove(v)
                break
        else:
            return False
    return True


def _verified(pairs: DataFrame) -> DataFrame:
    """(tid, i, how) of pairs(tid, i, words, w, sig, s): those similar by signature and by bigrams, and the same word for
    word; ``how`` is 'equal' or 'slip'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, other, sig, s = (b.column(n).to_pylist() for n in ("words", "w", "sig", "s"))
            ok, how = [], []
            for u, v, x, y in zip(words, other, sig, s):
                good = u == v
                if not good and int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) >= LEAST_EQUAL and same_title(u, v):
                    g, k = grams(u), grams(v)
                    good = len(g & k) >= LEAST_SIMILAR * len(g | k)
                ok.append(good)
                how.append("equal" if u == v else "slip")
            yield pa.RecordBatch.from_arrays([b.column("tid"), b.column("i"), pa.array(how, pa.string())], ["tid", "i", "how"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("tid", "i", "words", "w", "sig", "s").mapInArrow(run, "tid bigint, i bigint, how string")


class History:
    """What is accepted, in folders of the shared file system: keys and titles, partitioned by the high bits of their hashes.

    The number of partitions follows the size: it is set by the first delivery at ``BUCKET_ROWS`` keys each, and
    ``compact`` sets it anew when the history has outgrown it, in one pass, which also joins the small files of batches.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _state(self) -> tuple[str, int] | None:
        """(folder, partitions) of the newest whole generation; None before the first."""
        try:
            made = self.spark.read.schema("generation int, buckets int").parquet(f"{self.path}/generations")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        r = made.orderBy(F.desc("generation")).first()
        return None if r is None else (f"{self.path}/{r.generation}", r.buckets)

    def _begin(self, generation: int, n_keys: int) -> tuple[str, int]:
        buckets = 1 << max(0, (max(1, n_keys // BUCKET_ROWS) - 1).bit_length())
        self.spark.createDataFrame([(generation, buckets)], "generation int, buckets int").coalesce(1).write.mode("append").parquet(f"{self.path}/generations")
        return f"{self.path}/{generation}", buckets

    @staticmethod
    def _bucket(key: str, buckets: int) -> Column:
        return F.shiftrightunsigned(F.col(key), 64 - max(1, buckets.bit_length() - 1)).cast("int") if buckets > 1 else F.lit(0)

    def _write(self, rows: DataFrame, folder: str, key: str, buckets: int) -> None:
        """Few files for a small batch, and as many tasks as the session shuffles with for a large one."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = F.pmod(F.col(key), F.lit(max(1, n // buckets)))
        rows.withColumn("bucket", self._bucket(key, buckets)).repartition(n, F.col("bucket"), spread).write.mode("append").partitionBy("bucket").parquet(folder)

    def _read(self, name: str, schema: str) -> DataFrame:
        state = self._state()
        if state is None:
            return self.spark.createDataFrame([], schema)
        try:
            return self.spark.read.schema(schema + ", bucket int").parquet(f"{state[0]}/{name}").drop("bucket")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _matching(self, name: str, schema: str, key: str, wanted: DataFrame) -> DataFrame:
        """The kept rows with a key of ``wanted(key)``: of the partitions those hit, of their rows those with the key,
        by broadcast where the batch is small; a large batch and the history are joined as they lie."""
        state = self._state()
        if state is None:
            return self.spark.createDataFrame([], schema)
        used = [r[0] for r in wanted.select(self._bucket(key, state[1]).alias("b")).distinct().collect()]  # as many as there are partitions at most
        try:
            kept = self.spark.read.schema(schema + ", bucket int").parquet(f"{state[0]}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        if len(used) < state[1]:
            kept = kept.where(F.col("bucket").isin(used))
        return kept.drop("bucket").join(broadcast_if_small(wanted.select(key).distinct(), 20_000), key, "left_semi").select(*[x.strip().split(" ")[0] for x in schema.split(",")])

    def keys(self) -> DataFrame:
        return self._read("keys", _KEYS)

    def titles(self) -> DataFrame:
        return self._read("titles", _TITLES)

    def append(self, c: DataFrame) -> None:
        """Keep what rows of ``canonical`` are known by, unseen; for the first delivery."""
        t = materialize(titles(c), "titles")
        self._keep(materialize(simple_keys(c).union(band_keys(t)), "keys"), t)

    def _keep(self, k: DataFrame, t: DataFrame) -> None:
        folder, buckets = self._state() or self._begin(0, k.count())
        self._write(k, f"{folder}/keys", "key", buckets)
        self._write(t.select("tid", "proof", "words", "sig", "id"), f"{folder}/titles", "tid", buckets)

    def compact(self) -> None:
        """The history anew with partitions of its present size; the generation before stays until it is removed."""
        state = self._state()
        if state is None:
            return
        k, t = self.keys(), self.titles()
        n, generation = k.count(), int(state[0].rsplit("/", 1)[1]) + 1
        buckets = 1 << max(0, (max(1, n // BUCKET_ROWS) - 1).bit_length())
        self._write(k, f"{self.path}/{generation}/keys", "key", buckets)
        self._write(t, f"{self.path}/{generation}/titles", "tid", buckets)
        self._begin(generation, n)  # from here on it is the one that is read

    def _near(self, t: DataFrame, bands: DataFrame) -> DataFrame:
        """(tid, i, how): for titles of a batch the ids of same titles, kept or in the batch, by the bands they share."""
        old = self._matching("keys", _KEYS, "key", bands).where("kind = 2").select("key", F.col("tid").alias("o"), F.col("id").alias("i"))
        known = old.union(bands.select("key", F.col("tid").alias("o"), F.col("id").alias("i")))
        mine = bands.select("key", "tid", "last")
        # a pair meets once a band it shares; partial aggregation folds these before they are shuffled
        pairs = materialize(mine.join(known, "key").where("i < last").groupBy("tid", "o").agg(F.min("i").alias("i")), "pairs")
        others = self._matching("titles", _TITLES, "tid", pairs.select(F.col("o").alias("tid")).distinct())
        others = others.select("tid", "proof", "words", "sig").union(t.select("tid", "proof", "words", "sig")).dropDuplicates(["tid"])
        both = pairs.join(t.select("tid", F.col("proof").alias("p"), "words", "sig"), "tid").join(
            others.select(F.col("tid").alias("o"), "proof", F.col("words").alias("w"), F.col("sig").alias("s")), "o"
        )
        return _verified(both.where("p = proof"))

    def probe(self, c: DataFrame, k: DataFrame, t: DataFrame) -> DataFrame:
        """(id, accepted_id, how) of the rows of ``c``, whose keys are ``k`` and titles ``t``, that repeat a row with a smaller
        id; ``how`` names what found that row: 'id', 'page', 'equal' or 'slip'."""
        simple = k.where("kind < 2")
        old = self._matching("keys", _KEYS, "key", simple).where("kind < 2")
        same = old.select("kind", "proof", "id").union(simple.select("kind", "proof", "id")).groupBy("kind", "proof").agg(F.min("id").alias("least"))
        same = materialize(same.join(simple.select("kind", "proof"), ["kind", "proof"], "left_semi"), "same")
        bands = k.where("kind = 2").join(t.select("tid", "last"), "tid")
        near = self._near(t, materialize(bands.select("kind", "key", "tid", "id", "last"), "bands"))
        near = near.groupBy("tid").agg(F.min(F.struct("i", "how")).alias("m")).select("tid", F.col("m.i").alias("least"), F.col("m.how").alias("how"))
        near = materialize(near.join(t.select("tid", "proof", "words"), "tid").drop("tid"), "near")
        # rows meet what they are known by; a key that many rows have lies on the side that may be split
        at = lambda kind: broadcast_if_small(same.where(F.col("kind") == kind).drop("kind"), 20_000)
        each = c.where(F.col("company").isNotNull() & F.col("words").isNotNull()).select("id", "words", F.explode(_wheres()).alias("place"), "company")
        each = each.select("id", F.concat_ws(" @ ", "company", "place").alias("proof"), "words")
        rows = (
            c.select("id", F.col("ext").alias("proof")).join(at(0), "proof").select("id", "least", F.lit("id").alias("how"))
            .union(c.select("id", F.col("page").alias("proof")).join(at(1), "proof").select("id", "least", F.lit("page").alias("how")))
            .union(each.join(broadcast_if_small(near, 20_000), ["proof", "words"]).select("id", "least", "how"))
            .where("least < id")
        )
        return rows.groupBy("id").agg(F.min(F.struct("least", "how")).alias("m")).select("id", F.col("m.least").alias("accepted_id"), F.col("m.how").alias("how"))

    def take(self, c: DataFrame) -> DataFrame:
        """``probe`` a batch of ``canonical`` rows, then append what is new in it.

        Keys and titles that are known already, with the smaller id they stand for, are not appended again. A repeat
        that brings a key of its own (the same id under another title) adds that key with its own id: a later row may
        repeat it and nothing else.
        """
        t = materialize(titles(c), "titles")
        k = materialize(simple_keys(c).union(band_keys(t)), "keys")
        found = materialize(self.probe(c, k, t), "found")
        if self._state() is not None:
            kt = self._matching("titles", _TITLES, "tid", t)
            t = materialize(t.join(kt, (t.tid == kt.tid) & (t.proof == kt.proof) & (t.words == kt.words) & (kt.id <= t.id), "left_anti"), "new")
            simple = k.where("kind < 2")
            ks = self._matching("keys", _KEYS, "key", simple).where("kind < 2")
            simple = simple.join(ks, (simple.kind == ks.kind) & (simple.proof == ks.proof) & (ks.id <= simple.id), "left_anti")
            k = simple.union(k.where("kind = 2").join(t.select("tid"), "tid", "left_semi").select(*k.columns))
        self._keep(k, t)
        return found
