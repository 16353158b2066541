"""Event counts, failure rates, operating figures and diagnoses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled")


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def failure_rate(events: DataFrame, kind: str) -> DataFrame:
    """One row: 100 * events of a kind / all events, 0 without any, to 2 places."""
    hit = F.count_if(F.col("event_type") == kind)
    return events.agg(F.count("*").alias("total"), hit.alias("failed")).select("total", "failed", F.when(F.col("total") > 0, F.round(100 * F.col("failed") / F.col("total"), 2)).otherwise(0.0).alias("failure_rate"))


def latest_progress(events: DataFrame, key: str, seq: str, status: str = "status") -> DataFrame:
    """The progress that a watcher of each job sees last: a terminal status once there was one, else the newest."""
    columns = [c for c in events.columns if c != key]
    terminal = F.col(status).isin(*TERMINAL)
    best = F.max_by(F.struct(*columns), F.struct(terminal, F.col(seq))).alias("r")
    return events.groupBy(key).agg(best).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def job_stats(pages: DataFrame, resources: DataFrame) -> DataFrame:
    """By scan: pages, failed pages, resources, mean milliseconds of a page."""
    p = pages.groupBy("scan_job_id").agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg("page_ms"), 1).alias("avg_page_ms"))
    r = resources.groupBy("scan_job_id").agg(F.count("*").alias("resources"))
    return p.join(r, "scan_job_id", "left").withColumn("resources", F.coalesce("resources", F.lit(0)))


def diagnosis(pages: DataFrame) -> DataFrame:
    """By scan: fetched, pending and failed pages, the commonest failure (the least name of equals), and what it comes to."""
    top = pages.where("status = 'failed'").groupBy("scan_job_id", "failure_reason").agg(F.count("*").alias("n"))
    top = top.groupBy("scan_job_id").agg(F.min_by("failure_reason", F.struct(-F.col("n"), F.col("failure_reason"))).alias("top_reason"))
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    got = pages.groupBy("scan_job_id").agg(n("fetched"), n("pending"), n("failed")).join(top, "scan_job_id", "left")
    verdict = F.when(F.col("failed") > 0, F.concat(F.lit("failed: "), F.col("top_reason"))).when(F.col("fetched") > 0, "fetched without resources").when(F.col("pending") > 0, "not started").otherwise("no pages")
    return got.withColumn("top_reason", F.coalesce("top_reason", F.lit(""))).withColumn("verdict", verdict)
