"""Lists, configuration and results in files."""

from __future__ import annotations

from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import blank_to_null, clean, split_values

#: Columns that hold lists, joined by a bar in files. Fixed values.
LISTS = ("role_families", "keywords", "match_reasons", "risk_flags")
WATCHLIST = "name string, sector string, category string, careers_url string, website_category string, ats_hint string, role_families array<string>, keywords array<string>, priority string, monitoring_hint string, status string, source_mode string"


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # configuration: one small file


def read_mapping(spark: SparkSession, path: str) -> dict[str, Any]:
    """A YAML file that must hold a mapping; an empty one is an empty mapping."""
    data = yaml.safe_load(_text(spark, path)) or {}
    if not isinstance(data, dict):
        raise ValueError(f"{path} holds no mapping")
    return data


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """The ``companies`` of a YAML file, other keys ignored; none if that is no list."""
    rows = read_mapping(spark, path).get("companies")
    names = [x.split()[0] for x in WATCHLIST.split(", ")]
    made = [tuple([str(v) for v in r.get(n) or []] if n in LISTS else None if r.get(n) is None else str(r[n]) for n in names) for r in (rows if isinstance(rows, list) else []) if isinstance(r, dict)]
    return spark.createDataFrame(made, WATCHLIST)


def at_least_one(value: Any, default: int) -> int:
    """A limit of a configuration: whole, 1 or more; what isn't a number gives the default."""
    try:
        return max(1, int(value))
    except (TypeError, ValueError):
        return default


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text; line breaks inside quotes are kept."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')


def company_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(company_name, website_url, careers_url) of a CSV file, whose columns may have other names, or of a text file of
    ``name|site|careers`` lines; lines without a name are left out, '#' begins a remark."""
    if path.lower().endswith(".csv"):
        df = read_text_table(spark, path)
        low = {c.strip().lower(): c for c in df.columns}

        def pick(*names: str):
            found = [blank_to_null(F.col(f"`{low[n]}`")) for n in names if n in low]
            return F.coalesce(*found) if found else F.lit(None).cast("string")

        out = df.select(pick("company_name", "company", "name").alias("company_name"), pick("website_url", "website", "site", "url").alias("website_url"), pick("careers_url", "careers", "jobs_url").alias("careers_url"))
    else:
        p = F.split("value", r"\|")
        df = spark.read.text(path).where(~F.trim("value").startswith("#"))
        out = df.select(*[blank_to_null(F.get(p, F.lit(i))).alias(n) for i, n in enumerate(("company_name", "website_url", "careers_url"))])
    return out.where("company_name is not null")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed candidates of a CSV file: 'true' texts to booleans, bar-joined lists to arrays."""
    df = read_text_table(spark, path)
    for c in df.columns:
        if c in LISTS or c.endswith("_list"):
            df = df.withColumn(c, split_values(F.col(c), r"\|"))
        elif c in ("approved", "needs_review"):
            df = df.withColumn(c, F.lower(clean(F.col(c))) == "true")
    return df


def import_rows(df: DataFrame, *, categories: tuple[str, ...] = ("bank", "market"), sectors: tuple[str, ...] = ("it consulting",)) -> DataFrame:
    """Rows of a long list that are to be watched, by category or sector; names squeezed, rows without one left out."""
    keep = F.lower(clean(F.col("category"))).isin(*categories) | F.lower(clean(F.col("sector"))).isin(*sectors)
    return df.where(keep & (clean(F.col("name")) != "")).withColumn("name", clean(F.col("name")))


def write_csv(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    """CSV with a header; arrays as JSON text, so that a reader gets them back. ``one_file`` for small reports only."""
    flat = df.select(*[F.to_json(F.col(c)).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    (flat.coalesce(1) if one_file else flat).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def export_jobs(jobs: DataFrame, path: str, status: str | None = None) -> DataFrame:
    """Postings in their fixed order: score, last sighting, id, all falling; NULL last."""
    out = (jobs if status is None else jobs.where(F.col("status") == status)).orderBy(F.desc("match_score"), F.desc("last_seen_at"), F.desc("id"))
    write_csv(out, path)
    return out


def markdown(title: str, sections: dict[str, DataFrame], limit: int = 50) -> str:
    """A report of small tables, at most ``limit`` lines each, with how many more there are."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        rows = df.limit(limit + 1).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("-" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows[:limit]]
        if len(rows) > limit:
            out.append(f"\nand {df.count() - limit} more")
        out.append("")
    return "\n".join(out)
