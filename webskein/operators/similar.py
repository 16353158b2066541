"""Near copies by SimHash: neighbours of one item, and greedy leader clusters of all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ZERO_SIMHASH, hamming

THRESHOLD = 15


def similar_items(items: DataFrame, target: DataFrame, threshold: int = THRESHOLD, k: int = 5) -> DataFrame:
    """The k nearest items of the target's scan. target: one row (id, scan_job_id, simhash); only it is broadcast."""
    t = F.broadcast(target.limit(1).select(F.col("id").alias("t_id"), F.col("scan_job_id").alias("t_job"), F.col("simhash").alias("t_hash")))
    near = items.join(t, (F.col("scan_job_id") == F.col("t_job")) & (F.col("id") != F.col("t_id"))).withColumn("distance", hamming(F.col("simhash"), F.col("t_hash")))
    return near.where(F.col("distance") <= threshold).orderBy("distance", F.desc("popularity_score"), "id").limit(k).select("id", "distance", "popularity_score")


def leader_clusters(items: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Greedy clusters within each scan, in order of falling score, then id: an item joins the first
    cluster whose first member is within threshold, or starts one. Returns scan_job_id, id, leader.

    Items without a fingerprint stay alone and lead nobody; those of 16 zeros join nobody but
    may lead. The rule looks at all earlier leaders, so a scan is worked through in order by
    one task; equal fingerprints are one item there, and only leaders are kept beside the
    batch at hand, in numpy. Scans are independent tasks.
    """
    usable = F.coalesce(F.col("simhash"), F.lit("")) != ""
    alone = items.where(~usable).select("scan_job_id", "id", F.col("id").alias("leader"))
    ranked = items.where(usable).select("scan_job_id", "id", "popularity_score", "simhash")
    # The first item of each fingerprint stands for it; the others go where it goes.
    best = F.struct(-F.col("popularity_score"), F.col("id"))
    heads = ranked.groupBy("scan_job_id", "simhash").agg(F.min(best).alias("o")).select("scan_job_id", "simhash", F.col("o.col1").alias("p"), F.col("o.id").alias("id"))

    def lead(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, hashes, ids, count = None, np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for frame in frames:
            out = []
            for j, h, i in zip(frame["scan_job_id"], frame["simhash"], frame["id"], strict=True):
                if j != job:
                    job, count = j, 0
                value, leader = np.uint64(int(h, 16)), None
                if count and h != ZERO_SIMHASH:
                    near = np.flatnonzero(np.bitwise_count(hashes[:count] ^ value) <= threshold)
                    leader = int(ids[near[0]]) if len(near) else None
                if leader is None:
                    if count == len(hashes):
                        hashes = np.concatenate([hashes, np.zeros(max(64, count), np.uint64)])
                        ids = np.concatenate([ids, np.zeros(max(64, count), np.int64)])
                    hashes[count], ids[count], count, leader = value, i, count + 1, i
                out.append(leader)
            yield pd.DataFrame({"scan_job_id": frame["scan_job_id"], "simhash": frame["simhash"], "leader": out})

    led = heads.repartition("scan_job_id").sortWithinPartitions("scan_job_id", "p", "id").select("scan_job_id", "simhash", "id")
    kind = items.schema["scan_job_id"].dataType.simpleString()
    led = led.mapInPandas(lead, f"scan_job_id {kind}, simhash string, leader long")
    zero = F.col("simhash") == ZERO_SIMHASH
    # Items of 16 zeros never join, so each leads itself.
    joined = ranked.join(led, ["scan_job_id", "simhash"]).select("scan_job_id", "id", F.when(zero, F.col("id")).otherwise(F.col("leader")).alias("leader"))
    return joined.unionByName(alone)


def cluster_report(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters of two items or more: leader, size, title, common_tags, avg_score; larger ones first."""
    rows = clusters.join(items.select("id", "title", "tags", "popularity_score"), "id")
    sizes = rows.groupBy("leader").agg(F.count("*").alias("size"), F.avg("popularity_score").alias("avg"), F.min_by("title", F.struct(-F.col("popularity_score"), F.col("id"))).alias("title"))
    # A tag is common to a cluster if as many members have it as there are members.
    tags = rows.select("leader", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("leader", "tag").agg(F.count("*").alias("n"))
    common = tags.join(sizes.select("leader", "size"), "leader").where("n = size").groupBy("leader").agg(F.array_join(F.sort_array(F.collect_set("tag")), ", ").alias("common_tags"))
    out = sizes.where("size > 1").join(common, "leader", "left")
    return out.select("leader", "size", "title", F.coalesce("common_tags", F.lit("")).alias("common_tags"), F.round("avg", 1).alias("avg_score")).orderBy(F.desc("size"), "leader")
