"""Operator 7, packing: length buckets of least padding, and token-budget batches inside them.

One histogram of all lengths is the only thing collected, a row for each distinct length:
n words of text have sqrt(2n) of them at most. Dynamic programming over it finds the
boundaries that minimise the tokens of padding in total. Then every document goes to its
bucket by a lookup, and batches are runs of a bucket's rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, seeded, word_count

#: Rows of a bucket that one task numbers.
ROWS_PER_LANE = 50_000


def optimal_boundaries(upper: list[int], count: list[int], n_buckets: int) -> list[int]:
    """The bucket uppers, at most n_buckets of them, that minimise sum(count * (upper of its bucket - upper)).

    upper is ascending, the length in each bin. cost(i, j) of a bucket over bins i..j
    satisfies the quadrangle inequality, so the best split moves right with j and each
    layer is filled by divide and conquer, all middles of a level at once:
    O(n_buckets * n * log n).
    """
    n = len(upper)
    if not n:
        return []
    u = np.array(upper, dtype=np.float64)
    rows = np.concatenate([[0.0], np.cumsum(np.array(count, dtype=np.float64))])
    best, cuts = u * rows[1:], []
    for _ in range(1, min(n_buckets, n)):
        new, cut = best.copy(), np.full(n, -1, dtype=np.int64)
        lo, hi, a, b = (np.array([x]) for x in (1, n - 1, 0, n - 2))
        while len(lo):
            j = (lo + hi) // 2
            sizes = np.minimum(b, j - 1) - a + 1
            starts = np.cumsum(sizes) - sizes
            i = np.arange(sizes.sum()) + np.repeat(a - starts, sizes)
            total = best[i] + np.repeat(u[j], sizes) * (np.repeat(rows[j + 1], sizes) - rows[i + 1])
            least = np.minimum.reduceat(total, starts)
            hits = np.flatnonzero(total == np.repeat(least, sizes))
            at = i[hits[np.searchsorted(hits, starts)]]  # the first of equals
            less = least < new[j]
            new[j[less]], cut[j[less]] = least[less], at[less]
            lo, hi, a, b = (np.concatenate(x) for x in ((lo, j + 1), (j - 1, hi), (a, at), (at, b)))
            left = lo <= hi
            lo, hi, a, b = lo[left], hi[left], a[left], b[left]
        best = new
        cuts.append(cut)
    out, j = [], n - 1
    for cut in reversed(cuts):
        out.append(j)
        # -1: one bucket fewer was as good from here on
        if cut[j] < 0:
            out.pop()
            continue
        j = int(cut[j])
    out.append(j)
    return [upper[k] for k in reversed(out)]


def pack_batches(docs: DataFrame, n_buckets: int = 16, batch_tokens: int = 65_536, seed: int = 7, id_col: str = "doc_id", length: Column | None = None) -> DataFrame:
    """A batch for each document: id_col, length, bucket, bucket_length, batch, position, padding.

    length defaults to the words of column text. bucket counts from 0 by length;
    bucket_length is its longest document, to which its rows are padded. A batch holds
    rows of one bucket, batch_tokens // bucket_length of them at most and at least one,
    so its padded size is within batch_tokens unless one document alone exceeds it.
    batch is "bucket-number": a bucket's rows come in the order of a seeded hash and at
    most one batch a bucket is not full. Ranges of that order, lanes, are numbered by a
    task each and the rows before a lane are added, so no task sees a whole bucket and
    the number of lanes changes nothing.

    Null and empty texts have length 0 and cost no padding of their own length; equal
    lengths always share a bucket; repeated rows are packed one by one; null ids are
    rows like others; an empty table gives no rows. Other columns are not read.
    """
    # Rows that share an id or have none are told apart by their texts, where there are any.
    own = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    rows = materialize(docs.select(F.col(id_col).alias("__id"), (word_count(F.col("text")) if length is None else F.coalesce(length, F.lit(0)).cast("long")).alias("length"), own.alias("__text")), "lengths")
    bins = sorted(tuple(r) for r in rows.groupBy("length").agg(F.count("*")).collect())
    uppers = optimal_boundaries([u for u, _ in bins], [n for _, n in bins], n_buckets)
    sizes = [0] * len(uppers)
    at = 0
    for u, n in bins:
        while u > uppers[at]:
            at += 1
        sizes[at] += n
    uppers, sizes = uppers or [0], sizes or [1]
    bounds = F.array(*[F.lit(u).cast("long") for u in uppers])
    lanes = F.array(*[F.lit(-(-n // ROWS_PER_LANE)).cast("long") for n in sizes])
    bucket = sum((F.when(F.col("length") > u, 1).otherwise(0) for u in uppers[:-1]), F.lit(0))
    dealt = rows.withColumn("bucket", bucket.cast("int"))
    dealt = dealt.withColumn("bucket_length", F.element_at(bounds, F.col("bucket") + 1))
    dealt = dealt.withColumn("__h", seeded(seed, F.col("__id"), F.col("length"), F.col("__text")))
    # The lane of a hash: its upper 24 bits, from 0, in so many equal ranges.
    dealt = dealt.withColumn("__lane", F.shiftright((F.shiftright("__h", 40) + (1 << 23)) * F.element_at(lanes, F.col("bucket") + 1), 24))
    before = Window.partitionBy("bucket").orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("bucket", "__lane").agg(F.count("*").alias("__n")).select("bucket", "__lane", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.col("bucket_length"), F.lit(1))))
    numbered = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("bucket", "__lane").orderBy("__h", "__id", "__text")) - 1)
    numbered = numbered.join(F.broadcast(starts), ["bucket", "__lane"]).withColumn("__r", F.col("__start") + F.col("__r"))
    return numbered.select(
        F.col("__id").alias(id_col), "length", "bucket", "bucket_length",
        F.concat_ws("-", "bucket", F.floor(F.col("__r") / capacity)).alias("batch"),
        (F.col("__r") % capacity).cast("int").alias("position"),
        (F.col("bucket_length") - F.col("length")).alias("padding"),
    )
