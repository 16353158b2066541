"""The crawl frontier: what to fetch next, and reachability over a link table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .stored import stored


def page_cap(max_pages: int) -> int:
    """Pages that a scan may come to know: ten times those that it is to fetch, 10,000 at least."""
    return max(10 * max_pages, 10_000)


def new_links(links: DataFrame, visited: DataFrame, seed: Column, max_depth: int = 3, max_pages: int | None = None) -> DataFrame:
    """Links (url, depth) to follow: normalised, on the seed's site, no noise, within depth, not visited; the least depth of each.

    seed may be a column of links. With max_pages the best of them, so many that they and the
    visited ones are within the scan's page cap.
    """
    seen = visited.select(urls.fingerprint(urls.normalize(F.col("url"))).alias("fp")).distinct()
    rows = links.where((F.col("depth") <= max_depth) & urls.allowed(urls.normalize(F.col("url")), seed)).select(urls.normalize(F.col("url")).alias("url"), "depth")
    rows = rows.groupBy("url").agg(F.min("depth").alias("depth"))
    rows = rows.withColumn("fp", urls.fingerprint(F.col("url"))).join(seen, "fp", "left_anti").select("url", "depth", "fp", urls.priority(F.col("url"), F.col("depth")).alias("score"))
    if max_pages is None:
        return rows
    return next_batch(rows, max(0, page_cap(max_pages) - seen.count()), "fp")


def next_batch(frontier: DataFrame, k: int, key: str = "page_id") -> DataFrame:
    """The k best pages, by falling score, then URL, depth and key."""
    return frontier.orderBy(F.desc("score"), "url", "depth", key).limit(k)


def resume_split(pages: DataFrame) -> DataFrame:
    """By scan and state: pages that wait and pages that were visited."""
    return pages.withColumn("state", F.when(F.col("status") == "pending", "pending").otherwise("visited")).groupBy("scan_job_id", "state").agg(F.count("*").alias("n"))


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int, checkpoint=stored) -> DataFrame:
    """(node, depth) within max_depth steps of a seed: one round a depth, each an anti join with what was seen.

    edges: src, dst; seeds: node. Each round is checkpointed, so the plan stays short.
    """
    seen = checkpoint(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, max_depth + 1):
        step = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = checkpoint(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen
