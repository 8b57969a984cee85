"""Landed answers of posting systems, one JSON text per board, to posting rows.

Shapes that are fixed are read with a schema; those that change their type from record to record are read as VARIANT.
Text that isn't JSON gives no postings and the status 'parse_error'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import blank_to_null, clean, epoch_text, place_text, strip_tags
from postmill.operators.identity import external_id

COLUMNS = ("company_name", "source_name", "ats_type", "board_slug", "external_job_id", "title", "location", "job_url", "apply_url", "description", "date_posted")

_GREENHOUSE = "struct<jobs:array<struct<id:string,title:string,absolute_url:string,location:struct<name:string>,content:string,first_published:string,updated_at:string,created_at:string>>>"
_LEVER = (
    "array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,categories:struct<location:string,allLocations:array<string>>,descriptionPlain:string,description:string,"
    "lists:array<struct<text:string,content:string>>,additional:string,additionalPlain:string,createdAt:string>>"
)


def _base(df: DataFrame) -> list[Column]:
    return [F.col("company_name"), F.col("source_name"), F.col("board_slug")]


def unescape(c: Column) -> Column:
    """The five entities that feeds escape their markup with."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def greenhouse(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """``landed(company_name, source_name, board_slug, payload)`` to postings; a payload without ``jobs`` has none."""
    j = landed.select(*_base(landed), F.explode(F.from_json(F.col(payload), _GREENHOUSE)["jobs"]).alias("j"))
    return j.select(
        "company_name", "source_name", F.lit("greenhouse").alias("ats_type"), "board_slug", external_id([F.col("j.id")], F.col("j.absolute_url"), [F.col("j.title")]).alias("external_job_id"),
        blank_to_null(F.col("j.title")).alias("title"), blank_to_null(F.col("j.location.name")).alias("location"), F.col("j.absolute_url").alias("job_url"), F.col("j.absolute_url").alias("apply_url"),
        strip_tags(unescape(F.col("j.content"))).alias("description"), F.coalesce("j.first_published", "j.updated_at", "j.created_at").alias("date_posted"),
    )


def lever(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """A bare array of postings; the text is the description, then each list with its heading, then what is added."""
    j = landed.select(*_base(landed), F.explode(F.from_json(F.col(payload), _LEVER)).alias("j"))
    lists = F.transform(F.coalesce(F.col("j.lists"), F.array()), lambda x: F.concat_ws("\n", blank_to_null(x["text"]), strip_tags(F.regexp_replace(x["content"], "</li>", " "))))
    text = F.concat_ws("\n\n", blank_to_null(F.coalesce(F.col("j.descriptionPlain"), strip_tags(F.col("j.description")))), F.nullif(F.array_join(lists, "\n\n"), F.lit("")), blank_to_null(F.coalesce(F.col("j.additionalPlain"), strip_tags(F.col("j.additional")))))
    return j.select(
        "company_name", "source_name", F.lit("lever").alias("ats_type"), "board_slug", external_id([F.col("j.id")], F.col("j.hostedUrl"), [F.col("j.text")]).alias("external_job_id"),
        blank_to_null(F.col("j.text")).alias("title"), blank_to_null(F.col("j.categories.location")).alias("location"), F.col("j.hostedUrl").alias("job_url"), F.coalesce("j.applyUrl", "j.hostedUrl").alias("apply_url"),
        F.nullif(text, F.lit("")).alias("description"), epoch_text(F.col("j.createdAt")).alias("date_posted"),
    )


def _places(v: Column) -> Column:
    """Texts of a place that may be text, an object or a list of either."""
    one = lambda x: F.coalesce(
        F.try_variant_get(x, "$.name", "string"),
        place_text(F.array(*[F.coalesce(F.try_variant_get(x, f"$.{k}", "string"), F.lit("")) for k in ("city", "region", "country")])),
        F.when(~F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", "string")),
    )
    many = F.try_variant_get(v, "$", "array<variant>")
    return F.when(v.isNull(), F.array().cast("array<string>")).when(many.isNotNull(), F.transform(many, one)).otherwise(F.array(one(v)))


def ashby(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """``jobs``, ``jobPostings``, ``openings`` or a bare list; ids under three names; places of any shape."""
    v = landed.select(*_base(landed), F.try_parse_json(F.col(payload)).alias("v"))
    listed = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in ("$.jobs", "$.jobPostings", "$.openings", "$")])
    j = v.select("company_name", "source_name", "board_slug", F.explode(listed).alias("j"))
    g = lambda k: F.try_variant_get("j", f"$.{k}", "string")
    places = F.concat(_places(F.try_variant_get("j", "$.location", "variant")), _places(F.try_variant_get("j", "$.secondaryLocations", "variant")))
    return j.select(
        "company_name", "source_name", F.lit("ashby").alias("ats_type"), "board_slug", external_id([g("id"), g("jobPostingId"), g("jobId")], g("jobUrl"), [g("title")]).alias("external_job_id"),
        blank_to_null(g("title")).alias("title"), place_text(F.array_compact(places), " | ").alias("location"), g("jobUrl").alias("job_url"), F.coalesce(g("applyUrl"), g("jobUrl")).alias("apply_url"),
        F.coalesce(blank_to_null(g("descriptionPlain")), strip_tags(g("descriptionHtml"))).alias("description"), g("publishedAt").alias("date_posted"),
    )


READERS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby}


def read_boards(landed: DataFrame, system: str = "ats_type", payload: str = "payload") -> DataFrame:
    """Postings of all boards, each by its system; systems without a reader give none."""
    out = None
    for name, reader in READERS.items():
        one = reader(landed.where(F.col(system) == name), payload)
        out = one if out is None else out.unionByName(one)
    return out


def outcomes(landed: DataFrame, found: DataFrame, payload: str = "payload") -> DataFrame:
    """(source_name, status, jobs_discovered): 'success', 'no_jobs_found' or 'parse_error' per landed board."""
    n = found.groupBy("source_name").agg(F.count(F.lit(1)).alias("jobs_discovered"))
    j = landed.select("source_name", F.try_parse_json(F.col(payload)).isNull().alias("broken")).join(n, "source_name", "left")
    status = F.when(F.col("broken"), "parse_error").when(F.coalesce("jobs_discovered", F.lit(0)) > 0, "success").otherwise("no_jobs_found")
    return j.select("source_name", status.alias("status"), F.coalesce("jobs_discovered", F.lit(0)).alias("jobs_discovered"))


def normalize(rows: DataFrame) -> DataFrame:
    """Raw postings to the columns of storage: texts trimmed, blanks NULL, company and title squeezed."""
    text = [blank_to_null(F.col(c)).alias(c) for c in COLUMNS if c not in ("company_name", "title")]
    return rows.select(clean(F.col("company_name")).alias("company_name"), clean(F.col("title")).alias("title"), *text)
