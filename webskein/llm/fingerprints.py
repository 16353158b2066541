"""Operator 4, document fingerprints: bottom-k sketches of hashed word shingles.

A fingerprint is the ascending array of the k least distinct 48-bit hashes of a text's
shingles. Fingerprints of parts merge into the fingerprint of the whole, and two of them
estimate resemblance, containment and the number of distinct shingles. All of it is made
of built-in functions; no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Hashes of a sketch, words of a shingle. The error of a resemblance is at most 0.5 / sqrt(K) = 0.044.
K, SHINGLE = 128, 5
HASH_SPACE = 1 << 48
#: Rows of one cell of the id order, which one window sorts at once, and cells at most: their bounds are all that reaches
#: the driver, 36 bytes each, so at 5 * 10^10 rows a cell has some 800,000.
ROWS_PER_CELL, MOST_CELLS = 2048, 1 << 16


def tokens(text: Column) -> Column:
    """Lower-cased words; an empty array for null, empty and blank texts."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def bottom_k(toks: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The sketch of an array of words, which must be a stored column. Fewer words than a
    shingle: the whole sequence is the one shingle; no words: an empty sketch."""
    n = F.size(toks)
    low = lambda c: c.bitwiseAND(F.lit(HASH_SPACE - 1))
    hashes = F.when(n >= shingle, F.transform(F.sequence(F.lit(1), n - (shingle - 1)), lambda i: low(F.xxhash64(F.slice(toks, i, shingle)))))
    hashes = hashes.when(n > 0, F.array(low(F.xxhash64(toks)))).otherwise(F.array().cast("array<long>"))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: how many of the k least hashes of both are in each. Two empty sketches: 1."""
    union = merge(a, b, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th least hash as a fraction."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit((k - 1) * float(HASH_SPACE)) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def encode(a: Column) -> Column:
    """A sketch as text: six bytes a hash, in base 64; empty for an empty sketch."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 12, "0")), "")))


def merge_groups(sketches: DataFrame, group: str, sketch: str = "sketch", k: int = K, lanes: int = 64) -> DataFrame:
    """One sketch a group from any number of rows: equal hashes meet before the shuffle, and
    a group's hashes are cut to k in lanes first, so a hot group is never in one task.
    Rows with a null or empty sketch add nothing; a group of only such rows has no row."""
    hashes = sketches.select(group, F.explode(sketch).alias("h")).distinct()
    lane = F.pmod("h", F.lit(lanes))
    part = hashes.withColumn("lane", lane).withColumn("r", F.row_number().over(Window.partitionBy(group, "lane").orderBy("h"))).where(F.col("r") <= k)
    whole = part.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("h"))).where(F.col("r") <= k)
    return whole.groupBy(group).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def order_key(number: Column, body: Column) -> Column:
    """A string that sorts by the number, null first, and then by the text's hash."""
    number = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.coalesce(number, F.lit("")), F.lit("-"), F.lpad(F.hex(F.xxhash64(body)), 16, "0"))


def next_in_order(docs: DataFrame, key: str, carry: list[str], rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """docs with next_<c>, for each c in carry, of the next row in descending key, a string (after the last: the first).

    The order is cut into cells by key; every row moves once, to its cell, and the first
    row of each cell also to the end of the cell before. Only one bound a cell reaches
    the driver, MOST_CELLS at most. Rows of one key are next to each other in any order.
    """
    keys = docs.select(key)
    cells = min(MOST_CELLS, max(1, -(-keys.count() // rows_per_cell)))
    ranged = keys.repartitionByRange(cells, F.col(key).desc()).groupBy(F.spark_partition_id().alias("p")).agg(F.max(key).alias("first"))
    firsts = sorted({r["first"] for r in ranged.collect()}, reverse=True)
    step = max(1, math.isqrt(len(firsts)))
    # Two levels of bounds, constants of the plan; a row looks at some sqrt(cells) of each.
    at = F.size(F.filter(F.split(F.lit(",".join(firsts[::step])), ","), lambda f: f >= F.col(key)))
    groups = F.split(F.lit(";".join(",".join(firsts[i : i + step]) for i in range(0, len(firsts), step))), ";")
    rows = docs.withColumn("__at", at).withColumn("__in", F.split(F.element_at(groups, F.col("__at")), ","))
    rows = rows.withColumn("__cell", (F.col("__at") - 1) * step + F.size(F.filter("__in", lambda f: f >= F.col(key))) - 1)
    before = F.when(F.col("__cell") > 0, F.col("__cell") - 1).otherwise(len(firsts) - 1)
    # Rows that share the key of a cell's first row go to the cell before, too: any of them may be the first there.
    here = F.struct(F.col("__cell").alias("cell"), F.lit(False).alias("ghost"))
    places = F.when(F.array_contains("__in", F.col(key)), F.array(here, F.struct(before.alias("cell"), F.lit(True).alias("ghost")))).otherwise(F.array(here))
    dealt = rows.withColumn("__place", F.explode(places)).drop("__at", "__in", "__cell")
    order = Window.partitionBy("__place.cell").orderBy("__place.ghost", F.col(key).desc())
    led = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry])
    return led.where("not __place.ghost").drop("__place")


def fingerprint_edits(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited form of it, and how alike they are.

    The edited text has the last third of the text's code points (rounded down) replaced
    by the first as many, or all, of the next text in descending id, after the last the
    first. Returns id_col, n_chars, edited_sha256, sketch, edited_sketch, distinct_shingles,
    near_edited and near_next (resemblance to the edited and to the next text), contained
    (share of the text's shingles that the edited text has).

    Null texts count as empty; an empty text has an empty sketch, alike only to other
    empty ones. Null ids come last; rows of one id, or of none, follow each other by their
    text's hash, descending; a single row is its own next. An empty table gives no rows.
    Ids are integers; other columns are not read.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(order_key(F.col(id_col).cast("long"), body).alias("key"), F.col(id_col).alias("__id"), body.alias("body"))
    rows = rows.withColumn("toks", tokens(F.col("body"))).withColumn("sketch", bottom_k(F.col("toks"), k)).drop("toks")
    rows = next_in_order(rows, "key", ["body", "sketch"])
    n = F.char_length("body")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - cut), F.substring(F.col("next_body"), F.lit(1), cut))
    rows = rows.select("__id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.withColumn("toks", tokens(F.col("edited"))).withColumn("edited_sketch", bottom_k(F.col("toks"), k)).drop("toks")
    s, e, x = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        F.col("__id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "edited_sketch",
        distinct_shingles(s, k).alias("distinct_shingles"), resemblance(s, e, k).alias("near_edited"),
        resemblance(s, x, k).alias("near_next"), containment(s, e, k).alias("contained"),
    )
