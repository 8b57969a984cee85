"""The few functions that need another language's library to the letter: percent escapes and JSON escapes.

They run in Arrow batches; where the letter does not matter, ``urls.identity_url`` and ``identity.content_hash`` are
native and give the same grouping.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from postmill.functions.text import norm


def _address(text: str | None) -> str | None:
    t = (text or "").strip()
    if not t:
        return None
    try:
        p = urlsplit(t)
    except ValueError:
        return t
    if not p.scheme or not p.netloc:
        return t
    q = urlencode(sorted(parse_qsl(p.query, keep_blank_values=True)))
    return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/") or "/", q, ""))


@pandas_udf(StringType())
def address(c: pd.Series) -> pd.Series:
    """As ``urls.identity_url``, with the query's escapes written anew; broken addresses stay as they are."""
    return c.map(_address)


@pandas_udf(StringType())
def _canonical_hash(s: pd.DataFrame) -> pd.Series:
    cols = list(s.columns)

    def one(row: tuple) -> str:
        made = json.dumps({k: None if v is None or v != v else v for k, v in zip(cols, row)}, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(made.encode()).hexdigest()

    return pd.Series([one(r) for r in s.itertuples(index=False, name=None)], dtype="object")


def content_hash_exact() -> Column:
    """SHA-256 of JSON with sorted keys in which everything beyond ASCII is escaped."""
    text = [norm(F.col(c)).alias(c) for c in ("title", "location", "description", "external_job_id", "ats_type", "board_slug")]
    return _canonical_hash(F.struct(*text, address(F.col("job_url")).alias("job_url")))


_FOUND = StructType([StructField(n, IntegerType() if n == "position" else StringType()) for n in ("strategy", "position", "title", "href", "location", "text", "date_posted")])


@udtf(returnType=_FOUND)
class ExtractPostings:
    """``SELECT * FROM extract_postings(html, base_url)``: records of one page."""

    def eval(self, html: str, base_url: str) -> Iterator[tuple]:
        from postmill.operators.extract import parse_page

        yield from parse_page(html, base_url)[0]


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL."""
    spark.udtf.register("extract_postings", ExtractPostings)
    spark.udf.register("identity_address", address)
