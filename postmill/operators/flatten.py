"""Nested JSON records to related flat tables.

One pass, depth first: every element of every array leaves as a row with the tag of its table (its path without the
positions), its own path as primary key, its parent's path as foreign key and the scalars it holds itself. Rows of all
tables travel together; ``write_tables`` lays them out by tag in one write, ``table`` applies a schema to one tag.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "tag string, path string, parent_path string, ordinal int, kind string, payload string"
_ROWS = 20_000


class Malformed(ValueError):
    pass


def _no_constant(name: str) -> None:
    raise Malformed(name)


_decoder = json.JSONDecoder(parse_constant=_no_constant)


def parse(text: str):
    """The value of a JSON text; a string that holds JSON text counts as that text. Raises Malformed."""
    first = True
    while True:
        try:
            value = _decoder.decode(text)
        except RecursionError:
            value = _parse_deep(text)
        except ValueError as e:
            if first:
                raise Malformed(str(e)) from None
            return text  # an ordinary string
        if not isinstance(value, str):
            return value
        text, first = value, False


def _parse_deep(text: str):
    """As the decoder, with an own stack, for nesting deeper than the interpreter allows."""
    from json.decoder import scanstring

    stack: list = []  # containers that are open
    keys: list = []
    i, n = 0, len(text)
    want_value, value, have = True, None, False

    def skip(i: int) -> int:
        while i < n and text[i] in " \t\n\r":
            i += 1
        return i

    def key(i: int) -> tuple[str, int]:
        i = skip(i)
        if i >= n or text[i] != '"':
            raise Malformed("key")
        k, i = scanstring(text, i + 1, True)
        i = skip(i)
        if i >= n or text[i] != ":":
            raise Malformed("colon")
        return k, i + 1

    try:
        while True:
            i = skip(i)
            if want_value:
                if i >= n:
                    raise Malformed("end")
                c = text[i]
                if c in "[{":
                    j = skip(i + 1)
                    if j < n and text[j] == ("]" if c == "[" else "}"):
                        value, i, have = ([] if c == "[" else {}), j + 1, True
                    else:
                        stack.append([] if c == "[" else {})
                        keys.append(None)
                        i += 1
                        if c == "{":
                            keys[-1], i = key(i)
                        continue
                elif c == '"':
                    value, i = scanstring(text, i + 1, True)
                else:
                    value, i = _decoder.scan_once(text, i)
                want_value = False
                continue
            if not stack:
                if i != n:
                    raise Malformed("rest")
                return value
            top = stack[-1]
            if isinstance(top, list):
                top.append(value)
            else:
                top[keys[-1]] = value
            c = text[i] if i < n else ""
            if c == ",":
                i += 1
                if isinstance(top, dict):
                    keys[-1], i = key(i)
                want_value = True
            elif c == ("]" if isinstance(top, list) else "}"):
                value = stack.pop()
                keys.pop()
                i += 1
            else:
                raise Malformed("delimiter")
    except (StopIteration, ValueError) as e:
        raise Malformed(str(e)) from None


_KIND = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def visit(value, with_payload: bool = True) -> Iterator[tuple]:
    """(tag, path, parent_path, ordinal, kind, payload) of each array element below ``value``, depth first."""
    # what is still to see: (value, path, path of the nearest element, tag, ordinal or None)
    stack = [(value, "$", "$", "$", None)]
    while stack:
        v, path, parent, tag, ordinal = stack.pop()
        kind = type(v)
        if ordinal is not None:
            payload = None
            if with_payload:
                payload = json.dumps(_own(v) if kind is dict else [] if kind is list else v, ensure_ascii=False)
            yield tag, path, parent, ordinal, _KIND[kind], payload
            parent = path
        if kind is dict:
            for k, x in reversed(v.items()):
                if type(x) in (dict, list):
                    stack.append((x, f"{path}.{k}", parent, f"{tag}.{k}", None))
        elif kind is list:
            below = f"{tag}[]"
            for i in range(len(v) - 1, -1, -1):
                stack.append((v[i], f"{path}[{i}]", parent, below, i))


def _own(v: dict) -> dict:
    """The scalars of an object and of objects inside it, under dotted keys; arrays are other tables."""
    out, todo = {}, [("", v)]
    while todo:
        prefix, x = todo.pop()
        for k, y in x.items():
            if type(y) is dict:
                todo.append((f"{prefix}{k}.", y))
            elif type(y) is not list:
                out[prefix + k] = y
    return out


def _clean(s: str | None) -> str | None:
    """Half surrogates have no UTF-8 form; they become the replacement character."""
    if s is None:
        return None
    try:
        s.encode()
        return s
    except UnicodeEncodeError:
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def flatten(df: DataFrame, key: str, column: str, *, with_payload: bool = True) -> DataFrame:
    """(key, tag, path, parent_path, ordinal, kind, payload): one row per array element at any depth.

    NULL, blank and malformed texts give no rows, as do records without arrays and empty arrays. NaN and Infinity are
    malformed. Of equal keys in one object the last holds. Paths are of the form ``$.a[0].b``; a key with dots or
    brackets is written as it stands. Rows with equal keys each give their own elements. No shuffle.
    """
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "tag", "path", "parent_path", "ordinal", "kind", "payload"]
        for batch in batches:
            at: list[int] = []
            cols: list[list] = [[], [], [], [], [], []]
            keys = batch.column(0)
            for r, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text is None or ("[" not in text):
                    continue
                try:
                    value = parse(text)
                except Malformed:
                    continue
                for row in visit(value, with_payload):
                    at.append(r)
                    for c, x in zip(cols, row):
                        c.append(x)
                    if len(at) >= _ROWS:
                        yield _batch(keys, at, cols, names)
                        at, cols = [], [[], [], [], [], [], []]
            if at:
                yield _batch(keys, at, cols, names)

    src = df.select(F.col(key).alias("_key"), F.col(column).alias("_text"))
    out = src.mapInArrow(run, f"_key {key_type.simpleString()}, {SCHEMA}")
    return out.withColumnRenamed("_key", key)


def _batch(keys: pa.Array, at: list[int], cols: list[list], names: list[str]) -> pa.RecordBatch:
    def text(c: list) -> pa.Array:
        try:
            return pa.array(c, pa.string())
        except UnicodeEncodeError:
            return pa.array([_clean(x) for x in c], pa.string())

    arrays = [keys.take(pa.array(at, pa.int32())), text(cols[0]), text(cols[1]), text(cols[2]), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string()), text(cols[5])]
    return pa.RecordBatch.from_arrays(arrays, names)


def write_tables(flat: DataFrame, path: str) -> None:
    """All tables in one write, a folder per tag. Hot tags are spread over tasks, since no shuffle gathers a tag."""
    flat.write.partitionBy("tag").mode("overwrite").parquet(path)


def tables(spark: SparkSession, path: str, key_type: str, key: str) -> DataFrame:
    """All rows of ``write_tables``; empty where none were written."""
    schema = f"`{key}` {key_type}, path string, parent_path string, ordinal int, kind string, payload string, tag string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def tags(spark: SparkSession, path: str) -> list[str]:
    """The tables that were written: as many as the records have shapes of paths."""
    return sorted(r[0] for r in tables(spark, path, "string", "_key").select("tag").distinct().collect())


def infer(spark: SparkSession, path: str, tag: str) -> str:
    """A schema of the scalars of one table: keys of its objects, numbers as double, booleans as boolean, else string."""
    one = spark.read.parquet(path).where(F.col("tag") == tag)
    each = one.where("kind = 'object'").select(F.explode(F.from_json("payload", "map<string,string>")).alias("k", "v")).where("v is not null")
    number, boolean = F.col("v").try_cast("double").isNotNull() & F.col("v").rlike(r"^-?\d"), F.col("v").isin("true", "false")
    kinds = each.groupBy("k").agg(F.min(number).alias("n"), F.min(boolean).alias("b")).orderBy("k").collect()  # one row per key
    name = lambda k: "`" + k.replace("`", "``") + "`"
    return ", ".join(f"{name(r.k)} {'double' if r.n else 'boolean' if r.b else 'string'}" for r in kinds)


def table(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """One flat table of ``write_tables`` with the scalars of ``schema`` as columns."""
    flat = spark.read.parquet(path).where(F.col("tag") == tag).drop("tag")
    kept = [c for c in flat.columns if c != "payload"]
    if not schema:
        return flat.select(*kept)
    parsed = flat.select("*", F.from_json("payload", schema).alias("_p"))
    inner = parsed.schema["_p"].dataType.names
    # a scalar named as a column of the table keeps its name behind a mark
    return parsed.select(*kept, *[F.col("_p").getField(n).alias(f"_{n}" if n in kept else n) for n in inner])
