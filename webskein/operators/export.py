"""Exports: resources, tags and events as CSV and JSON rows, and how they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOURCE_COLUMNS = "id title url cover_url views likes hearts category published_at popularity_score".split()
#: Where a field may come from, and the fields that say so.
ORIGINS = ("jsonld", "opengraph", "twitter", "microdata", "dom", "missing")


def read_raw_data(raw: Column) -> Column:
    """struct<provenance: map, description: string> of the stored JSON; what can't be read is empty, unknown origins go."""
    got = F.from_json(raw, "provenance map<string,string>, description string")
    known = F.map_filter(F.coalesce(got["provenance"], F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(v.isin(*ORIGINS), F.lit(False)))
    return F.struct(known.alias("provenance"), F.coalesce(got["description"], F.lit("")).alias("description"))


def write_raw_data(provenance: Column, description: Column) -> Column:
    """The JSON to store, with its keys in order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(provenance)))
    return F.to_json(F.struct(F.coalesce(description, F.lit("")).alias("description"), ordered.alias("provenance")))


def resource_rows(resources: DataFrame) -> DataFrame:
    """The CSV columns: tags joined by "; ", sources the provenance as JSON with its keys in order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(read_raw_data(F.col("raw_data"))["provenance"])))
    return resources.select(*RESOURCE_COLUMNS, F.array_join("tags", "; ").alias("tags"), F.to_json(ordered).alias("sources"))


def resource_json(resources: DataFrame) -> DataFrame:
    """One JSON object a row, with tags as a list, provenance as an object, and description."""
    raw = read_raw_data(F.col("raw_data"))
    return resources.select(F.to_json(F.struct(*RESOURCE_COLUMNS, "tags", raw["provenance"].alias("provenance"), raw["description"].alias("description"))).alias("value"))


def tag_rows(tag_counts: DataFrame) -> DataFrame:
    return tag_counts.select("id", "name", "resource_count")


def tag_json(tag_counts: DataFrame) -> DataFrame:
    return tag_counts.select(F.to_json(F.struct("id", "name", "resource_count")).alias("value"))


def event_json(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)
