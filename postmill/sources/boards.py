"""``spark.read.format("postings")``: landed board answers as a source of its own, one partition per file."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "company_name string, source_name string, ats_type string, board_slug string, payload string"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [_File(self.path)]
        return [_File(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".jsonl")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    x = json.loads(line)
                    p = x.get("payload")
                    yield (x.get("company_name"), x.get("source_name"), x.get("ats_type"), x.get("board_slug"), p if isinstance(p, str) or p is None else json.dumps(p))


class LandedBoards(DataSource):
    """Lines of JSON: which board, and its answer as text or as an object."""

    @classmethod
    def name(cls) -> str:
        return "postings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedBoards)
