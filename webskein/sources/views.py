"""The analytics tables, derived from the star-schema tables of a data folder.

resources: one row a part, with counters from its line items and a publish date; tags as
an array. resource_tags and tags are exploded from it. scan_jobs: one row a part size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum("l_quantity").cast("long").alias("views"),
        F.count("*").alias("likes"),
        F.count_if(F.col("l_returnflag") == "R").alias("hearts"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return table(spark, sf_dir, "part").join(line, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"),
        F.col("p_size").alias("scan_job_id"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("https://shop.example/part/"), F.col("p_partkey")).alias("url"),
        F.col("p_type").alias("category"),
        zero("views"), zero("likes"), zero("hearts"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd").alias("published_at"),
        F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_type", "p_brand"))).alias("tags"),
    )


def resource_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).select("id", "scan_job_id", F.explode("tags").alias("name"))


def scan_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.timestamp_add("DAY", F.col("id"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("id")).distinct().withColumn("created_at", made)


#: The same views for the SQL side.
SQL = """
line AS (
    SELECT l_partkey, sum(l_quantity)::BIGINT AS views, count(*) AS likes, count(*) FILTER (WHERE l_returnflag = 'R') AS hearts
    FROM lineitem GROUP BY 1
), resources AS (
    SELECT p_partkey AS id, p_size AS scan_job_id, p_name AS title, 'https://shop.example/part/' || p_partkey AS url, p_type AS category,
           coalesce(views, 0)::BIGINT AS views, coalesce(likes, 0)::BIGINT AS likes, coalesce(hearts, 0)::BIGINT AS hearts,
           strftime(DATE '2024-01-01' + p_size, '%Y-%m-%d') AS published_at, p_name, p_type, p_brand
    FROM part LEFT JOIN line ON l_partkey = p_partkey
), resource_tags AS (
    SELECT DISTINCT id, scan_job_id, unnest(string_split(p_name, ' ') || [p_type, p_brand]) AS name FROM resources
), tags AS (
    SELECT scan_job_id, name, count(*) AS resource_count FROM resource_tags GROUP BY 1, 2
), scan_jobs AS (
    SELECT DISTINCT p_size AS id, TIMESTAMP '2024-01-01' + p_size * INTERVAL 1 DAY AS created_at FROM part
)"""
