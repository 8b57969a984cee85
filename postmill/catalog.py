"""Reading what is kept: one place for the questions that views and commands ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators import classify as C
from postmill.operators import observe as O
from postmill.operators.identity import keep_first
from postmill.runtime import load

#: Tables that become views. Fixed values.
TABLES = ("companies", "sources", "jobs", "job_snapshots", "source_observations", "interventions", "documents")


class Catalog:
    """Frames over a folder of tables; ``register`` gives them to SQL users as views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    def register(self, prefix: str = "") -> None:
        for t in TABLES:
            self.table(t).createOrReplaceTempView(prefix + t)

    def jobs(self, status: str | None = None) -> DataFrame:
        """Postings with what is known of their company, best first."""
        j = self.table("jobs") if status is None else self.table("jobs").where(F.col("status") == status)
        c = keep_first(self.table("companies"), [F.col("name")], F.asc("id")).select(F.col("name").alias("_name"), "sector", "category", "priority")
        return j.join(c, j.company_name == F.col("_name"), "left").drop("_name").orderBy(F.desc("match_score"), F.desc("last_seen_at"), F.desc("id"))

    def new_jobs(self) -> DataFrame:
        return self.jobs("new")

    def job(self, job_id: int) -> DataFrame:
        return self.table("jobs").where(F.col("id") == job_id)

    def companies(self, mode: str | None = None, needing_url: bool = False, limit: int | None = None) -> DataFrame:
        c = self.table("companies")
        if mode is not None:
            c = c.where(F.col("source_mode") == mode)
        if needing_url:
            c = c.where(F.trim(F.coalesce("careers_url", F.lit(""))) == "").orderBy(F.desc("priority"), "name")
        else:
            p = F.lower(F.trim(F.coalesce("priority", F.lit(""))))
            c = c.orderBy(F.when(p == "high", 1).when(p == "medium", 2).when(p == "low", 3).otherwise(4), "name")
        return c if limit is None else c.limit(limit)

    def source_status(self) -> DataFrame:
        """Sources with their last observation, state, streak and open issue."""
        st = F.trim(F.col("status"))
        obs = O.streaks(self.table("source_observations"), key="source_name", order=[F.asc("observed_at"), F.asc("observation_id")], fails=st.isin(*C.ERROR, "paused"), succeeds=st.isin(*C.SUCCESS), at="observed_at")
        last = O.latest(obs, ["source_name"], F.desc("observed_at"), F.desc("observation_id"))
        last = last.select("source_name", "collector", "status", "error", "intervention_required", "jobs_discovered", "consecutive_failures", "last_success_at", "observed_at")
        s = self.table("sources").join(last, "source_name", "left")
        s = s.withColumn("readiness", C.readiness(F.col("status"), F.col("source_mode"), F.col("collector"), F.col("intervention_required")))
        return O.with_issues(s, self.table("interventions"))

    def overview(self) -> DataFrame:
        return O.metrics(self.table("source_observations"))

    def issues(self, status: str | None = "open") -> DataFrame:
        i = self.table("interventions")
        return O.collapse(i if status is None else i.where(F.col("status") == status)).orderBy(F.desc("latest.at"), F.desc("latest.id"))

    def issue_history(self, limit: int = 20) -> DataFrame:
        return self.table("interventions").orderBy(F.desc(F.coalesce("resolved_at", "detected_at", "created_at")), F.desc("id")).limit(limit)
