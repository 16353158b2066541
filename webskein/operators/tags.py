"""Tag statistics. A resource's tags are an array; resource_tags rows are (id, scan_job_id, name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(resource_tags: DataFrame) -> DataFrame:
    """Resources of each tag of each scan."""
    return resource_tags.groupBy("scan_job_id", "name").agg(F.countDistinct("id").alias("resource_count"))


def overview(resources: DataFrame) -> DataFrame:
    """Per scan: tags, resources, and links over resources to one place."""
    each = resources.select("scan_job_id", "id", F.explode_outer(F.array_distinct("tags")).alias("name"))
    got = each.groupBy("scan_job_id").agg(F.countDistinct("name").alias("total_tags"), F.countDistinct("id").alias("total_resources"), F.count("name").alias("links"))
    return got.select("scan_job_id", "total_tags", "total_resources", F.round(F.col("links") / F.col("total_resources"), 1).alias("avg_tags"))


def cooccurrence(resources: DataFrame, k: int | None = 20) -> DataFrame:
    """Pairs of tags by resources that have both. Pairs come from one resource's own tags, made in place."""
    tags = F.array_sort(F.array_distinct("tags"))
    pairs = F.flatten(F.transform(tags, lambda a: F.transform(F.filter(tags, lambda b: b > a), lambda b: F.struct(a.alias("tag_a"), b.alias("tag_b")))))
    found = resources.select(F.explode(pairs).alias("p")).groupBy("p.tag_a", "p.tag_b").agg(F.count("*").alias("n"))
    return found if k is None else found.orderBy(F.desc("n"), "tag_a", "tag_b").limit(k)


def gravity(scored: DataFrame, tag_counts: DataFrame, k: int = 30) -> DataFrame:
    """Score per volume of the k tags of most score; a tag's resource count is added once for each link."""
    links = scored.select("scan_job_id", F.explode(F.array_distinct("tags")).alias("name"), F.col("popularity_score").cast("decimal(20,2)").alias("score"))
    # Links fold to a row for each tag of a scan before they meet its count.
    per = links.groupBy("scan_job_id", "name").agg(F.count("*").alias("links"), F.sum("score").alias("score"))
    met = per.join(tag_counts, ["scan_job_id", "name"])
    agg = met.groupBy("name").agg(F.countDistinct("scan_job_id").alias("site_coverage"), F.sum(F.col("links") * F.col("resource_count")).alias("volume"), F.sum("links").alias("links"), F.sum("score").cast("double").alias("total"))
    top = agg.where("volume > 2").orderBy(F.desc("total"), "name").limit(k)
    return top.select("name", "site_coverage", "volume", F.round(F.col("total") / F.col("links"), 2).alias("avg_score"), F.round("total", 1).alias("score"), F.round(F.col("total") / F.col("volume"), 2).alias("gravity")).orderBy(F.desc("gravity"), "name")


def velocity(tag_counts: DataFrame, jobs: DataFrame, now: Column, days: int = 3, k: int = 15) -> DataFrame:
    """Tags by resources of scans of the last days over those of earlier ones plus one, in one pass."""
    recent = F.col("created_at") > F.timestamp_add("DAY", F.lit(-days), now)
    met = tag_counts.join(jobs.select(F.col("id").alias("scan_job_id"), "created_at"), "scan_job_id")
    agg = met.groupBy("name").agg(
        F.sum(F.when(recent, F.col("resource_count"))).alias("recent"),
        F.coalesce(F.sum(F.when(~recent, F.col("resource_count"))), F.lit(0)).alias("baseline"),
    )
    agg = agg.where("recent is not null").withColumn("velocity", F.round(F.col("recent") / (F.col("baseline") + 1), 4))
    return agg.orderBy(F.desc("velocity"), F.desc("recent"), "name").limit(k)


def cloud(tag_counts: DataFrame, k: int = 30) -> DataFrame:
    return tag_counts.groupBy("name").agg(F.sum("resource_count").alias("total")).orderBy(F.desc("total"), "name").limit(k)


def gaps(gravity_rows: DataFrame, competitors: int = 2, k: int = 5) -> DataFrame:
    """Tags of high score that few scans cover."""
    return gravity_rows.where(F.col("site_coverage") <= competitors).orderBy(F.desc("score"), "name").limit(k)
