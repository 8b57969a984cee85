"""Texts longer than a limit, cut into pieces at natural boundaries, with overlap.

A long text is read in ranges of bytes with halos, never as a whole beyond one range, be it a value of a table or a file.
Each range finds where units (words with their blanks) begin in it; these boundary tables are stitched, so that every range
knows the units that are its own, wherever the one before ends. Each unit is looked at once: how many ids it adds, how
good a cut after it would be. Sums of ids over the ranges of a text give every unit its place in the whole, the whole's
size gives the number and the nominal places of the cuts, and each range offers its best boundary near those it holds.
Pieces are then pairs of neighbouring cuts: offsets and numbers of ids, without the text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.tokens import _WS, _WS_RE2, SEP, Encoder, encoder, plain_blanks, slices
from postmill.runtime import broadcast_if_small, materialize

#: Bytes of a range; texts of no more characters are read as one.
RANGE = 32_768
#: Characters of a unit; longer runs without any boundary are cut at every so many from their beginning.
MOST_UNIT = 2_048
#: A unit of more ids is cut inside; fewer where limits are tight, so that each nominal place has a unit's end near.
MOST_IDS = 24
#: Share of the room between overlap and limit that pieces aim at; cuts move by a third of that.
FILL = 0.75
#: Limits that are read by the driver; more are refused.
MOST_LIMITS = 1000
#: Ids kept free for units that are cut inside a word.
SPARE = 8
PARAGRAPH, LINE, SENTENCE, WORD, INSIDE = 4, 3, 2, 1, 0
NAMES = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", WORD: "word", INSIDE: "inside a word"}
_ABBREVIATED = set("approx vs sec e.g i.e dr mr mrs ms prof st ext re no fig cf etc inc ltd corp co p pp vol ca resp incl dept est".split())
_ODD = re.compile(f" ?[^{_WS}]+[{_WS}]*|^[{_WS}]+")
_OTHER_RE2 = _WS_RE2.replace(" ", "")
_TAIL = re.compile(f"[{_WS}]*\\Z")
#: Where a unit begins: at the blank before a word, or at a word after another kind of blank.
_START = re.compile(f" (?=[^{_WS}])|(?<=[{_WS}])(?<! )[^{_WS}]")
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’)\]]*\Z")


def _odd_units(text: str) -> list[str]:
    u = _ODD.findall(text)
    for i in range(len(u) - 1):
        if u[i].endswith(" "):
            u[i], u[i + 1] = u[i][:-1], " " + u[i + 1]
    return [x for x in u if x]


class Unit:
    """What a unit is like, wherever it stands: characters, ids at the end of a piece, ids before a unit that starts
    without a blank, quality of a cut after it, how it starts."""

    __slots__ = ("alone", "chars", "cut", "lower", "space", "split")

    def __init__(self, text: str, enc: Encoder, inside: bool = False):
        self.chars = len(text)
        self.alone = len(enc.part(text)) if len(text) <= 64 else len(enc.encode(text))
        tail = _TAIL.search(text)[0]
        self.split = self.alone if len(tail) < 2 else len(enc.encode(text[:-1])) + len(enc.part(text[-1]))
        body = text[: len(text) - len(tail)]
        word = body.strip(" \"'“”‘’()[]").rstrip(".").lower()
        if tail.count("\n") > 1:
            self.cut = PARAGRAPH
        elif "\n" in tail:
            self.cut = LINE
        elif _SENTENCE.search(body) and not (body.endswith(".") and word in _ABBREVIATED):
            self.cut = SENTENCE
        else:
            self.cut = INSIDE if inside else WORD
        first = text.lstrip(" \"'“”‘’([")[:1]
        self.lower = first.islower() or first.isdigit()
        self.space = text.startswith(" ") and len(text.rstrip()) > 0


def _inside(text: str, enc: Encoder, most: int) -> list[str]:
    """A long unit in parts of at most ``most`` ids: at pre-tokens, else between characters."""
    out, held, size = [], "", 0
    for w in enc.split.findall(text):
        ids = enc.part(w)
        if len(ids) > most:
            if held:
                out.append(held)
                held, size = "", 0
            step = max(1, len(w) * most // (len(ids) + 1))
            at = 0
            while at < len(w):
                n = step
                while n > 1 and len(enc.part(w[at : at + n])) > most:
                    n = max(1, n * 2 // 3)
                out.append(w[at : at + n])
                at += n
            continue
        if size + len(ids) > most:
            out.append(held)
            held, size = "", 0
        held += w
        size += len(ids)
    if held:
        out.append(held)
    return out


class Units:
    """The units of a batch of texts as arrays; each distinct unit is looked at once per process."""

    def __init__(self, enc: Encoder, most: int = MOST_IDS):
        self.enc, self.most = enc, most
        self.memo: dict[str, list[Unit]] = {}

    def _look(self, text: str) -> list[Unit]:
        got = self.memo.get(text)
        if got is None:
            one = Unit(text, self.enc) if len(text) <= MOST_UNIT else None
            got = [one]
            if one is None or one.alone > self.most:
                parts = [p for i in range(0, len(text), MOST_UNIT) for p in _inside(text[i : i + MOST_UNIT], self.enc, self.most)]
                got = [Unit(p, self.enc, True) for p in parts[:-1]] + [Unit(parts[-1], self.enc)]
            if len(text) <= 64:
                if len(self.memo) > 300_000:
                    self.memo.clear()
                self.memo[text] = got
        return got

    def batch(self, texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(columns of all units, offsets of the texts in them)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = plain_blanks(texts)
        some = texts.filter(pa.array(plain))
        some = pc.replace_substring_regex(some, f"([{_OTHER_RE2}])([^{_WS_RE2}])", f"\\1{SEP}\\2")
        lists = pc.split_pattern(pc.replace_substring(some, " ", SEP + " "), SEP)
        odd = np.flatnonzero(~plain)
        found = [_odd_units(t) for t in texts.take(pa.array(odd)).to_pylist()]
        parts = pa.concat_arrays([lists.flatten().cast(pa.large_string()), pa.array([u for x in found for u in x], pa.large_string())])
        codes = parts.dictionary_encode()
        each = [self._look(u) if u else [] for u in codes.dictionary.to_pylist()]
        per = np.fromiter(map(len, each), np.int64, len(each))
        flat = [u for x in each for u in x]
        cols = {n: np.fromiter((getattr(u, n) for u in flat), np.int64, len(flat)) for n in Unit.__slots__}
        first = np.concatenate([[0], np.cumsum(per)])
        idx = codes.indices.to_numpy().astype(np.int64)
        # order of the texts: plain ones lie first, then the odd ones
        own = np.diff(lists.offsets.to_numpy().astype(np.int64))
        size, base = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        size[plain], size[odd] = own, [len(x) for x in found]
        base[plain] = np.concatenate([[0], np.cumsum(own)])[:-1]
        base[odd] = own.sum() + np.concatenate([[0], np.cumsum(size[odd])])[:-1]
        bounds = np.concatenate([[0], np.cumsum(size)])
        idx = idx[np.repeat(base - bounds[:-1], size) + np.arange(bounds[-1])]
        n = per[idx]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(first[idx] - ends[:-1], n) + np.arange(ends[-1])
        return {k: v[at] for k, v in cols.items()}, ends[bounds]


def _context(u: dict[str, np.ndarray], bounds: np.ndarray, follows: list[Unit | None] | None = None, inside: list[bool] | None = None) -> tuple[np.ndarray, ...]:
    """(characters, ids in place, ids at an end, quality) of the units of all texts, by what follows each in its text.

    ``follows`` is the unit after the last of each text, if the text goes on; ``inside`` says that it is the same unit going on.
    """
    chars, alone, cut = u["chars"], u["alone"], u["cut"].copy()
    space, lower = np.append(u["space"][1:], 1), np.append(u["lower"][1:], 0)
    some = np.diff(bounds) > 0
    last = bounds[1:][some] - 1
    space[last], lower[last] = 1, 0
    for r, x in zip(np.flatnonzero(some), last):
        if follows is not None and follows[r] is not None:
            space[x], lower[x] = follows[r].space, follows[r].lower
            if inside[r] and cut[x] == WORD:
                cut[x] = INSIDE
    cut[(cut == SENTENCE) & (lower == 1)] = WORD
    return chars, np.where(space == 1, alone, u["split"]), alone, cut


def _grid(total: int, most: int, overlap: int) -> tuple[int, float]:
    """(pieces, ids between nominal cuts) of a text of ``total`` ids."""
    if total <= most:
        return 1, float(max(1, total))
    room = max(4, most - overlap - SPARE)
    n = int(np.ceil(total / (FILL * room)))
    return n, total / n


def _cuts(grid: tuple[int, float], overlap: int, chars0: int, ids0: int, chars: np.ndarray, mid: np.ndarray, alone: np.ndarray, cut: np.ndarray, lo: int, hi: int) -> list[tuple]:
    """Best cut per nominal place among the units lo..hi of one range: (place, quality, ids before, characters before,
    correction at an end, ids and characters before the overlap). Units before lo serve overlaps only."""
    n, g = grid
    if n < 2 or hi <= lo:
        return []
    ids = ids0 + np.concatenate([[0], np.cumsum(mid)])
    at = chars0 + np.concatenate([[0], np.cumsum(chars)])
    after = ids[lo + 1 : hi + 1]
    k = np.ceil(after / g - 1e-9).astype(np.int64)  # the place at or beyond
    ok = (after > k * g - g / 3) & (k >= 1) & (k < n)
    j = np.flatnonzero(ok)
    if not len(j):
        return []
    order = np.lexsort((after[j], cut[lo:hi][j], k[j]))
    j = j[order]
    last = np.append(np.flatnonzero(np.diff(k[j])), len(j) - 1)
    out = []
    for x in j[last]:
        e = lo + int(x) + 1  # units before e belong to the piece that ends here
        o = min(e, int(np.searchsorted(ids[: e + 1], ids[e] - overlap, "left"))) if overlap else e
        out.append((int(k[x]), int(cut[e - 1]), int(ids[e]), int(at[e]), int(alone[e - 1] - mid[e - 1]), int(ids[o]), int(at[o])))
    return out


_CUT = "doc_id {0}, row string, limit_name string, place int, quality int, ids bigint, chars bigint, fix int, over_ids bigint, over_chars bigint"
_RANGE = "doc_id {0}, row string, no int, n int, prev string, body string, ahead string"


def _range(read: Callable[[int, int], bytes], size: int, no: int, step: int) -> tuple[str, str, str]:
    """(character before, own text, what it sees of the next) of range ``no``, of ``step`` bytes, of ``size``; ``read`` gives bytes by offset.

    Ranges begin at the first whole character; bytes that are no UTF-8 become replacement characters.
    """
    lo, hi = no * step, min(size, (no + 1) * step)
    first = max(0, lo - 4)
    b = read(first, min(size, hi + 8 * MOST_UNIT + 64))
    at, end = lo - first, hi - first
    while lo and at < len(b) and b[at] & 0xC0 == 0x80:
        at += 1
    while end < len(b) and b[end] & 0xC0 == 0x80:
        end += 1
    prev = b[:at].decode("utf-8", "replace")[-1:]
    return prev, b[at:end].decode("utf-8", "replace"), b[end:].decode("utf-8", "ignore")[: 2 * MOST_UNIT + 8]


def _starts(prev: str, body: str, ahead: str) -> tuple[int | None, int | None]:
    """First and last character of ``body`` at which a unit begins."""
    first = last = None
    k = len(prev)
    for m in _START.finditer(prev + body + ahead[:1]):
        x = m.start() - k
        if 0 <= x < len(body):
            first, last = x if first is None else first, x
    return first, last


def ranges_of_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Ranges of text files, read by offset: each task opens the file and reads its own bytes. Paths are URIs of any file
    system all executors reach."""
    sizes, step = [], RANGE
    for p in paths:
        system, inner = fs.FileSystem.from_uri(p)
        sizes.append((p, system.get_file_info(inner).size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, no in zip(*(c.to_pylist() for c in b.columns)):
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_file(inner) as f:
                    got = _range(lambda a, z: f.read_at(z - a, a), size, no, step)
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.string()) for x in (path, path)), *(pa.array([x], pa.int32()) for x in (no, -(-size // step))), *(pa.array([x], pa.string()) for x in got)], ["doc_id", "row", "no", "n", "prev", "body", "ahead"])

    files = spark.createDataFrame(sizes, "path string, size bigint").where("size > 0")
    each = files.select("path", "size", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / RANGE) - 1).cast("int"))).alias("no"))
    return each.repartition(F.col("path"), F.col("no")).mapInArrow(run, _RANGE.format("string"))


def _ranges_of(long: DataFrame, kind: str) -> DataFrame:
    """Ranges of the texts of a table, cut by byte in one pass."""
    step = RANGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "no", "n", "prev", "body", "ahead"]
        for b in batches:
            for r in range(b.num_rows):
                view = memoryview(b.column(1)[r].as_buffer())
                size, row = len(view), uuid.uuid4().hex
                n = -(-size // step)
                for start in range(0, n, 64):
                    got = [(row, no, n, *_range(lambda a, z: bytes(view[a:z]), size, no, step)) for no in range(start, min(n, start + 64))]
                    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r] * len(got))), *[pa.array(c, t) for c, t in zip(zip(*got), types)]], names)

    return long.select("doc_id", "text").mapInArrow(run, _RANGE.format(kind))


def pieces(docs: DataFrame, limits: DataFrame, *, key: str = "doc_id", text: str = "text", folder: str = "/opt/tokenizers") -> DataFrame:
    """(limit_name, key, piece_no, start_char, end_char, n_tokens, overlap_tokens, boundary): one row per piece.

    Offsets count code points from 0. Each piece of a limit has at most ``max_tokens`` ids by the limit's vocabulary
    (``folder``/<tokenizer>.tiktoken) as it stands alone; it begins at most ``overlap_tokens`` ids before the end of
    the piece before it, at the beginning of a word. A text within the limit is one piece; empty and NULL texts have
    none. Texts without any boundary are cut between characters; there ``n_tokens`` is the sum over the parts, a few ids
    off what the piece has when encoded alone, and ``SPARE`` ids are kept free for that. Rows with equal keys each give
    their pieces. ``limits`` has at most ``MOST_LIMITS`` rows; more are refused.
    """
    kind = docs.schema[key].dataType.simpleString()
    src = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.length(text).alias("n_chars"))
    ranges = materialize(_ranges_of(src.where(F.col("n_chars") > RANGE), kind), "ranges")
    return _of_limits(docs.sparkSession, src.where(F.col("n_chars") <= RANGE), ranges, limits, kind, folder).withColumnRenamed("doc_id", key)


def pieces_of_files(spark: SparkSession, paths: list[str], limits: DataFrame, *, folder: str = "/opt/tokenizers") -> DataFrame:
    """``pieces`` of text files, by path: no task reads more of a file than one range and its halo."""
    return _of_limits(spark, None, materialize(ranges_of_files(spark, paths), "ranges"), limits, "string", folder).withColumnRenamed("doc_id", "path")


def _of_limits(spark: SparkSession, short: DataFrame | None, ranges: DataFrame, limits: DataFrame, kind: str, folder: str) -> DataFrame:
    rows = [r.asDict() for r in limits.limit(MOST_LIMITS + 1).collect()]
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    stitched = stitch(ranges)
    out = None
    for name in sorted({r["tokenizer"] for r in rows}):
        lim = [(r["limit_name"], int(r["max_tokens"]), int(r["overlap_tokens"])) for r in rows if r["tokenizer"] == name]
        one = _pieces(short, ranges, stitched, lim, f"{folder}/{name}.tiktoken", kind)
        out = one if out is None else out.union(one)
    if out is None:
        return spark.createDataFrame([], f"limit_name string, doc_id {kind}, piece_no int, start_char bigint, end_char bigint, n_tokens bigint, overlap_tokens bigint, boundary string")
    return out


def stitch(ranges: DataFrame) -> DataFrame:
    """(row, no, base, own, until, inner, ends): where each range begins, the characters it owns, and whether what follows is
    the same unit going on. One small row a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, prev, body, ahead = (b.column(i).to_pylist() for i in range(5))
            found = [_starts(*x) for x in zip(prev, body, ahead)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in body], pa.int32()), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32())], ["row", "no", "n_chars", "first", "last"])

    t = ranges.select("row", "no", "prev", "body", "ahead").mapInArrow(run, "row string, no int, n_chars int, first int, last int")
    w = Window.partitionBy("row").orderBy("no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = materialize(t, "starts").withColumn("base", F.coalesce(F.sum("n_chars").over(before), F.lit(0)))
    t = t.withColumn("last", F.when(F.col("no") == 0, F.coalesce("last", F.lit(0))).otherwise(F.col("last")))
    carry = F.last(F.col("base") + F.col("last"), ignorenulls=True).over(before)
    t = t.withColumn("carry", carry).withColumn("end", F.col("base") + F.col("n_chars"))
    going_on = F.col("carry") + F.ceil((F.col("base") - F.col("carry")) / MOST_UNIT) * MOST_UNIT
    real = F.coalesce(F.col("base") + F.col("first"), F.lit(2**62))
    own = F.when(F.col("no") == 0, F.lit(0)).otherwise(F.least(going_on, real, F.col("end")))
    t = t.withColumns({"own": own, "inner": (F.col("no") > 0) & (going_on < real) & (going_on < F.col("end"))})
    until = F.coalesce(F.lead("own").over(w), F.col("end"))
    t = t.withColumns({"until": until, "goes_on": F.coalesce(F.lead("inner").over(w), F.lit(False))})
    return materialize(t.select("row", "no", "base", "own", "until", "goes_on", F.max("end").over(Window.partitionBy("row")).alias("n_chars")), "stitched")


def _pieces(short: DataFrame | None, ranges: DataFrame, stitched: DataFrame, lim: list[tuple[str, int, int]], path: str, kind: str) -> DataFrame:
    most_ids = max(1, min([MOST_IDS, *[int(FILL * max(4, m - o - SPARE) / 6) for _, m, o in lim]]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of one range: pieces at once."""
        units = Units(encoder(path), most_ids)
        for b in batches:
            for part in slices(b, 1):
                u, bounds = units.batch(part.column(1))
                chars, mid, alone, cut = _context(u, bounds)
                sums, sizes = np.concatenate([[0], np.cumsum(mid)]), np.concatenate([[0], np.cumsum(chars)])
                ends = np.maximum(bounds[1:] - 1, 0)
                fix = np.where(np.diff(bounds) > 0, (alone - mid)[ends], 0) if len(mid) else np.zeros(len(bounds) - 1, np.int64)
                totals = (np.diff(sums[bounds]) + fix).tolist()
                lengths = np.diff(sizes[bounds]).tolist()
                got = []
                for r, (doc, total, length) in enumerate(zip(part.column(0).to_pylist(), totals, lengths)):
                    for name, most, overlap in lim:
                        if total <= most:
                            got.append((name, doc, 1, 0, length, total, 0, PARAGRAPH))
                            continue
                        a, z = int(bounds[r]), int(bounds[r + 1])
                        grid = _grid(total, most, overlap)
                        cuts = _cuts(grid, overlap, 0, 0, chars[a:z], mid[a:z], alone[a:z], cut[a:z], 0, z - a)
                        ids0 = from_ids = start = 0
                        for k, (_, quality, ids, at, end, o_ids, o_at) in enumerate([*cuts, (0, PARAGRAPH, total, length, 0, total, length)]):
                            got.append((name, doc, k + 1, start, at, ids + end - from_ids, ids0 - from_ids, quality))
                            ids0, from_ids, start = ids, o_ids, o_at
                yield _piece_batch(got, key_type(part))

    def _piece_batch(got: list[tuple], t: pa.DataType) -> pa.RecordBatch:
        types = [pa.string(), t, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        names = ["limit_name", "doc_id", "piece_no", "start_char", "end_char", "n_tokens", "overlap_tokens", "quality"]
        cols = list(zip(*got)) if got else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], names)

    def key_type(b: pa.RecordBatch) -> pa.DataType:
        return b.schema.field(0).type

    def _batch(got: list[tuple], t: pa.DataType) -> pa.RecordBatch:
        types = [t, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        names = ["doc_id", "row", "limit_name", "place", "quality", "ids", "chars", "fix", "over_ids", "over_chars"]
        cols = list(zip(*got)) if got else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The boundary table: the units a range owns, each looked at once."""
        units = Units(encoder(path), most_ids)
        names = ["doc_id", "row", "no", "n", "own", "n_chars", "chars", "mid", "alone", "cut"]
        for b in batches:
            for part in slices(b, 3):
                rest = part.to_pydict()
                own, follows = [], []
                for body, ahead, base, lo, hi in zip(*(rest[k] for k in ("body", "ahead", "base", "own", "until"))):
                    seen = body + ahead
                    own.append(seen[lo - base : hi - base])
                    nxt = seen[hi - base : hi - base + MOST_UNIT + 2]
                    m = _START.search(nxt, 1)
                    nxt = nxt[: min(m.start() if m else len(nxt), MOST_UNIT)]
                    follows.append(units._look(nxt)[0] if nxt else None)
                u, bounds = units.batch(pa.array(own, pa.string()))
                cols = _context(u, bounds, follows, rest["goes_on"])
                at = pa.array(bounds, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(c, pa.int32())) for c in cols]
                kept = [part.column(part.schema.get_field_index(k)) for k in ("doc_id", "row", "no", "n", "own", "n_chars")]
                yield pa.RecordBatch.from_arrays([*kept, *lists], names)

    whole_ranges = ranges.join(broadcast_if_small(stitched, 20_000), ["row", "no"]).select("doc_id", "row", "no", "body", "ahead", "n", "base", "own", "until", "goes_on", "n_chars")
    arrays = "chars array<int>, mid array<int>, alone array<int>, cut array<int>"
    table = materialize(whole_ranges.mapInArrow(look, f"doc_id {kind}, row string, no int, n int, own bigint, n_chars bigint, {arrays}"), "boundaries")
    w = Window.partitionBy("row")
    size = table.select("row", "no", F.aggregate("mid", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("size"))
    before = F.coalesce(F.sum("size").over(w.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = materialize(size.select("row", "no", before.alias("before"), F.sum("size").over(w).alias("total")), "places")
    # what overlaps may need of the range before: a unit has an id at least
    k = max(1, max(o for _, _, o in lim) + 1)
    back = lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - k + 1), F.lit(k)).alias("t_" + c)
    tails = table.select("row", (F.col("no") + 1).alias("no"), *[back(c) for c in ("chars", "mid", "alone", "cut")])

    def offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for r in b.to_pylist():
                tail, own = ([np.array(r[p + c] or [], np.int64) for c in ("chars", "mid", "alone", "cut")] for p in ("t_", ""))
                x = len(tail[0])
                chars, mid, alone, cut = (np.concatenate(z) for z in zip(tail, own))
                ids0, chars0 = r["before"] - int(tail[1].sum()), r["own"] - int(tail[0].sum())
                for name, most, overlap in lim:
                    grid = _grid(r["total"], most, overlap)
                    got += [(r["doc_id"], r["row"], name, *c) for c in _cuts(grid, overlap, chars0, ids0, chars, mid, alone, cut, x, len(chars))]
                    if r["no"] == 0:
                        got.append((r["doc_id"], r["row"], name, 0, PARAGRAPH, 0, 0, 0, 0, 0))
                        got.append((r["doc_id"], r["row"], name, grid[0], PARAGRAPH, r["total"], r["n_chars"], 0, r["total"], r["n_chars"]))
            yield _batch(got, b.schema.field(0).type)

    both = table.join(places, ["row", "no"]).join(tails, ["row", "no"], "left")
    both = both.select("doc_id", "row", "no", "own", "n_chars", "before", "total", "chars", "mid", "alone", "cut", "t_chars", "t_mid", "t_alone", "t_cut")
    far = both.mapInArrow(offers, _CUT.format(kind))
    best = F.max_by(F.struct("quality", "ids", "chars", "fix", "over_ids", "over_chars"), F.struct("quality", "ids"))
    far = far.groupBy("doc_id", "row", "limit_name", "place").agg(best.alias("c")).select("doc_id", "row", "limit_name", "place", "c.*")
    cuts = materialize(far, "cuts")
    # a piece lies between neighbouring cuts of its text; places near which no unit ends are passed over
    w = Window.partitionBy("row", "limit_name").orderBy("place")
    nxt = F.lead(F.struct("ids", "fix", "chars", "quality")).over(w)
    one = cuts.select("*", nxt.alias("n"), F.row_number().over(w).alias("piece_no")).where("n is not null").select(
        "limit_name", "doc_id", "piece_no", F.col("over_chars").alias("start_char"), F.col("n.chars").alias("end_char"), (F.col("n.ids") + F.col("n.fix") - F.col("over_ids")).alias("n_tokens"),
        (F.col("ids") - F.col("over_ids")).alias("overlap_tokens"), F.col("n.quality").alias("quality"),
    )
    if short is not None:
        one = one.union(short.select("doc_id", "text").mapInArrow(
            whole, f"limit_name string, doc_id {kind}, piece_no int, start_char bigint, end_char bigint, n_tokens bigint, overlap_tokens bigint, quality int"
        ))
    boundary = F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("quality"))
    return one.withColumn("boundary", boundary).drop("quality")


def texts(found: DataFrame, docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``found`` pieces with their texts, by offset; a text is taken apart once for all its pieces. Keys are unique here."""
    rest = [c for c in found.columns if c != key]
    by_doc = found.groupBy(key).agg(F.collect_list(F.struct(*rest)).alias("_p"))  # as many offsets as the text has pieces
    j = docs.select(F.col(key), F.col(text).alias("_text")).join(by_doc, key).select(key, "_p", "_text")
    kind = found.schema
    schema = ", ".join(f"`{c}` {kind[c].dataType.simpleString()}" for c in [key, *rest]) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                lists, t = b.column(1)[r].values, b.column(2)[r].as_py()
                cols = [lists.field(c) for c in rest]
                cut = [t[a:z] for a, z in zip(cols[rest.index("start_char")].to_pylist(), cols[rest.index("end_char")].to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r] * len(cut))), *cols, pa.array(cut, pa.string())], [key, *rest, "text"])

    return j.mapInArrow(run, schema).select(*found.columns, "text")
