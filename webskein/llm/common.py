"""Shared plumbing of the llm operators: projections, shared storage, ranks, components.

Nothing here is sized by the data on the driver: what is collected is a row per
partition, a row per Spark setting, or a sketch whose size is a parameter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run of anything but the blank and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a folder in the warehouse, which is shared, too."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/webskein-shared").rstrip("/")


def _path(spark: SparkSession, path: str):
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The folder is removed when the application ends, or earlier through ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webskein-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made, fs = _path(spark, path)
    fs.deleteOnExit(made)
    out = spark.read.schema(df.schema).parquet(path)
    out._webskein_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames; they must not be read again."""
    for df in frames:
        made, fs = _path(df.sparkSession, df._webskein_path)
        fs.delete(made, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, null for a null text; an empty array for blanks."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether a row may not be learnt from: crc32 of the id's text is divisible by 5 (null ids: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def seeded(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def global_rank(df: DataFrame, order: list[Column], rank: str) -> tuple[DataFrame, int]:
    """df with a gapless rank from 0 in the given total order, and the number of rows; no task sees all rows.

    Rows are dealt into ranges of the order and written; each range numbers its own
    rows, and the sizes of the ranges before it (a row per range) are added. A run of
    equal leading keys is split as long as a later key tells its rows apart.
    """
    from pyspark.sql import Window

    cols = [f"__o{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(order, cols, strict=True)])
    dealt = materialize(keyed.repartitionByRange(*cols).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__range").orderBy(*cols)
    ranked = dealt.withColumn("__row", F.row_number().over(inside)).join(F.broadcast(starts), "__range")
    return ranked.withColumn(rank, F.col("__start") + F.col("__row") - 1).drop("__range", "__row", "__start", *cols), dealt.count()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, component long): the smallest node reachable, for each node that has an edge.

    Rounds of hooking and shortcutting on labels: each round gives every node the
    smallest label among its neighbours' and its own, then every label its own label.
    The labels are written to the shared folder each round, so lineage stays short and
    nothing is collected but one count a round. A star needs two rounds, a path of n
    nodes O(log n). Nodes are not nullable; loops are ignored.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        own = small(labels)
        near = (
            both.join(own.select(F.col("node").alias("b"), F.col("component").alias("__c")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("__c").alias("__c"))
        )
        seen = own.join(near, "node").select("node", "component", F.least("component", "__c").alias("__new"))
        # What a node learns is told to the node its label names, too, so that whole trees hook at once.
        told = seen.where("__new < component").select(F.col("component").alias("node"), F.col("__new").alias("__c"))
        hooked = (
            seen.select("node", F.col("__new").alias("__c"))
            .unionByName(told)
            .groupBy("node")
            .agg(F.min("__c").alias("__new"))
        )
        hooked = materialize(hooked, "hooked")
        up = small(hooked).select(F.col("node").alias("__new"), F.col("__new").alias("__up"))
        jumped = hooked.join(up, "__new", "left").select("node", F.least("__new", "__up").alias("__new"))
        step = materialize(jumped.join(own, "node").select("node", F.col("__new").alias("component"), (F.col("__new") < F.col("component")).alias("__moved")), "labels")
        moved = step.where("__moved").limit(1).count()
        release(labels, hooked)
        labels = step
        if not moved:
            release(both)
            return labels.select("node", "component")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/webskein-{name}-{uuid.uuid4().hex}"
    made, fs = _path(spark, path)
    fs.mkdirs(made)
    fs.deleteOnExit(made)
    return path


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; df should be stored and narrow."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Within it, Arrow hands texts to Python at most so many rows at a time: a batch is held on both sides of the
    pipe, and the usual 10,000 long texts are too many. The setting is read when a plan runs, so what depends on it
    has to be stored before the end. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    if not 0 < int(was) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)
