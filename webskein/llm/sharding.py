"""Operator 10, sharding: rows in Hilbert-curve order of their metadata, cut into runs.

Several metadata columns are quantised to a few bits each; the position of the cell
on a Hilbert curve is the leading sort key, so a run of the order covers a compact
box of every column at once and a reader prunes shard files on any of them by min
and max. Runs are cut at equal row counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_rank, materialize, small

#: A dictionary of up to this many values is broadcast (about 10 MB); beyond it the join shuffles.
BROADCAST_VALUES = 100_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cells (rows x dimensions, each in [0, 2**bits)).

    The axes are brought into the curve's transposed form by undoing the excess work of
    each bit from the top, then Gray-coded, and their bits interleaved.
    """
    x = [c.astype(np.int64) for c in np.asarray(cells).T]
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0]) ^ swap
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn = np.where((x[n - 1] >> bit) & 1 == 1, turn ^ ((1 << bit) - 1), turn)
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ turn) >> bit) & 1)
    return out


def quantise_names(df: DataFrame, name: str, cell: str, bits: int) -> DataFrame:
    """df with the cell of a string column: its values in code point order (null first), dealt evenly."""
    ranked, n = global_rank(df.groupBy(F.col(name).alias("__v")).agg(F.lit(1).alias("__one")), [F.col("__v")], "__rank")
    lookup = ranked.select("__v", F.floor(F.col("__rank") * (1 << bits) / F.lit(max(n, 1))).cast("long").alias(cell))
    side = F.broadcast(lookup) if n <= BROADCAST_VALUES else lookup
    return df.join(side, df[name].eqNullSafe(side["__v"]), "left").drop("__v")


def quantise_size(size: Column, bits: int) -> Column:
    """The cell of a size: steps of a constant ratio, 2**bits of them up to 2**40."""
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * (1 << bits) / 40), F.lit((1 << bits) - 1)).cast("long")


def hilbert_shards(docs: DataFrame, n_shards: int = 24, bits: int = 8, id_col: str = "doc_id", text_col: str = "text", name_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Shards of equal row counts along the Hilbert curve over the name columns and the text's size.

    Returns id_col, the name columns, size (UTF-8 bytes of the text plus 8), text_crc32
    (unsigned, UTF-8), hilbert, shard, slot. Counts of shards are at most one apart and
    slots run from 0 without gaps. Only names, sizes and checksums are shuffled, never
    the texts. Equal texts are one group: where their names differ they take the least
    names of the group, so they follow each other on the curve; a group is in one shard
    unless one of the n_shards - 1 cuts, which equal counts force, falls into it. A cell
    that holds a third of all rows is split by the texts' hashes and ids.

    Null and empty texts have size 8 and checksum 0; null names are the least value;
    null ids are rows like others. Repeated rows each get a slot of their own. With
    fewer rows than shards some shards stay empty; an empty table gives no rows. Other
    columns of the input are neither read nor returned.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("__id"),
        *[F.col(c).alias(f"__n{i}") for i, c in enumerate(name_cols)],
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("__text"),
    )
    for i in range(len(name_cols)):
        rows = quantise_names(rows, f"__n{i}", f"__c{i}", bits)
    # The names of equal texts: one number, the least of the group's where they differ.
    names = reduce(lambda a, c: a * (1 << bits) + F.col(c), [f"__c{i}" for i in range(len(name_cols))], F.lit(0).cast("long"))
    rows = materialize(rows.withColumn("__names", names).drop(*[f"__c{i}" for i in range(len(name_cols))]), "named")
    text = ["__text", "text_crc32", "size"]
    differ = rows.groupBy(*text).agg(F.min("__names").alias("__least"), F.max("__names").alias("__most")).where("__least < __most").drop("__most")
    rows = rows.join(small(materialize(differ, "differ"), BROADCAST_VALUES), text, "left").withColumn("__names", F.coalesce("__least", "__names"))
    cells = [F.shiftright("__names", bits * i).bitwiseAND(F.lit((1 << bits) - 1)).alias(f"__c{i}") for i in reversed(range(len(name_cols)))]
    rows = rows.select("*", *cells, quantise_size(F.col("size"), bits).alias("__s"))
    dims = [*[f"__c{i}" for i in reversed(range(len(name_cols)))], "__s"]

    @F.pandas_udf("long")
    def curve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            yield pd.Series(hilbert_index(np.stack([p.to_numpy() for p in parts], axis=1), bits))

    rows = rows.withColumn("hilbert", curve(*dims)).drop(*dims, "__names", "__least")
    order = [F.col("hilbert"), F.col("text_crc32"), F.col("__text"), F.col("__id"), *[F.col(f"__n{i}") for i in range(len(name_cols))], F.col("size")]
    ranked, n = global_rank(rows, order, "__rank")
    shard = F.expr(f"__rank * {n_shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", shard.cast("int")).select(
        F.col("__id").alias(id_col), *[F.col(f"__n{i}").alias(c) for i, c in enumerate(name_cols)],
        "size", "text_crc32", "hilbert", "shard", (F.col("__rank") - first).cast("long").alias("slot"),
    )
