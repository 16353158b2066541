"""Popularity: counters against the maxima of a scan, and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of views, likes, hearts and recency.
W_VIEWS, W_LIKES, W_HEARTS, W_RECENCY = 0.4, 0.3, 0.2, 0.1
#: Formats of publish dates, in the order in which they are tried.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def recency(published_at: Column, now: Column) -> Column:
    """100 / (1 + ln(1 + whole days of age)); 50 for dates that are blank or can't be read; future dates have age 0."""
    at = F.coalesce(*[F.try_to_timestamp(published_at, F.lit(f)) for f in DATE_FORMATS])
    days = F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400), F.lit(0))
    return F.when(at.isNull(), F.lit(50.0)).otherwise(100 / (1 + F.log1p(days.cast("double"))))


def popularity(resources: DataFrame, now: Column, job: str = "scan_job_id") -> DataFrame:
    """resources with popularity_score, rounded to 2 places. A counter whose maximum in the scan is not above 0 adds nothing.

    The maxima are aggregated first and joined back, so a scan that holds most rows is
    not one window's partition.
    """
    top = resources.groupBy(F.col(job).alias("__job")).agg(*[F.max(c).alias(f"__{c}") for c in ("views", "likes", "hearts")])
    part = lambda c, w: F.when(F.col(f"__{c}") > 0, w * F.col(c) / F.col(f"__{c}") * 100).otherwise(0.0)
    score = part("views", W_VIEWS) + part("likes", W_LIKES) + part("hearts", W_HEARTS) + W_RECENCY * recency(F.col("published_at"), now)
    joined = resources.join(top, F.col(job).eqNullSafe(F.col("__job")))
    return joined.withColumn("popularity_score", F.round(score, 2)).drop("__job", "__views", "__likes", "__hearts")


def top_by_score(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("popularity_score"), "id").limit(k)


def top_per_tag(scored: DataFrame, k: int = 10) -> DataFrame:
    """The k best resources of every tag: tag, rank, id, popularity_score. One tag may cover all rows, so ranks
    are cut within lanes before they are cut within tags."""
    rows = scored.select(F.explode(F.array_distinct("tags")).alias("tag"), "id", "popularity_score")
    best = [F.desc("popularity_score"), F.col("id")]
    lane = Window.partitionBy("tag", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy(*best)
    few = rows.withColumn("rank", F.row_number().over(lane)).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy(*best))).where(F.col("rank") <= k).select("tag", "rank", "id", "popularity_score")
