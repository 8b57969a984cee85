"""Commands: ``python -m postmill.cli NAME ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame

from postmill.catalog import Catalog
from postmill.runtime import session
from postmill.sources import files


def _show(df: DataFrame, limit: int) -> None:
    for line in df.limit(limit).toJSON().collect():
        print(line)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="postmill")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("jobs", "companies", "status", "overview", "issues", "history"):
        s = sub.add_parser(name)
        s.add_argument("folder")
        s.add_argument("--status")
        s.add_argument("--mode")
        s.add_argument("--limit", type=int, default=20)
    s = sub.add_parser("export")
    s.add_argument("folder")
    s.add_argument("out")
    s.add_argument("--status")
    s = sub.add_parser("query", help="run a named query and write it")
    s.add_argument("name")
    s.add_argument("folder")
    s.add_argument("out")
    sub.add_parser("queries")
    a = p.parse_args(argv)
    if a.command == "queries":
        from postmill.plans import all_registries

        print(json.dumps(sorted(n for r in all_registries() for n in r.queries)))
        return 0
    spark = session(master=a.master)
    if a.command == "query":
        from postmill.plans import all_registries

        found = {n: q for r in all_registries() for n, q in r.queries.items()}
        found[a.name](spark, a.folder).write.mode("overwrite").parquet(a.out)
        return 0
    c = Catalog(spark, a.folder)
    if a.command == "export":
        files.export_jobs(c.table("jobs"), a.out, a.status)
        return 0
    frame = {
        "jobs": lambda: c.jobs(a.status), "companies": lambda: c.companies(a.mode), "status": c.source_status, "overview": c.overview,
        "issues": lambda: c.issues(a.status), "history": lambda: c.issue_history(a.limit),
    }[a.command]()
    _show(frame, a.limit)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
