"""Operator 9, embedding near-dedup: Euclidean p-stable hashing, then exact cosine checks.

Vectors are normalised, so a cosine of c is a distance of sqrt(2 - 2c). A table's key is
a row of quantised random projections floor((a.v + b) / width), a Gaussian; vectors that
share a key in some table are compared in double precision. The number of projections
follows from the number of vectors (a key should hold a fraction of a stranger), the
number of tables from the recall asked for at the threshold itself; links closer than
the threshold are found more surely.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

#: Strangers that a key is to hold on average, the quantisation width, members of one side of a block.
STRANGERS, WIDTH, SIDE = 0.25, 2.25, 1024


def collision(distance: float, width: float) -> float:
    """The chance that two vectors at a distance fall into one interval of a projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def parameters(n: int, threshold: float, recall: float, width: float = WIDTH) -> tuple[int, int]:
    """(projections per key, tables) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(n, 2) / STRANGERS) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log1p(-(near**k)))


class Tables:
    """The keys of vectors; the same on every executor, as all follows from the seed."""

    def __init__(self, k: int, n_tables: int, width: float, seed: int):
        self.k, self.n_tables, self.width, self.seed, self.drawn = k, n_tables, width, seed, {}

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables) of 64-bit keys for unit vectors of one dimension."""
        dim = unit.shape[1]
        if dim not in self.drawn:
            rng = np.random.default_rng([self.seed, dim])
            n = self.k * self.n_tables
            self.drawn[dim] = rng.standard_normal((dim, n)), rng.random(n) * self.width, rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b, odd = self.drawn[dim]
        out = np.empty((len(unit), self.n_tables), dtype=np.int64)
        for at in range(0, len(unit), 512):
            cell = np.floor((unit[at : at + 512] @ a + b) / self.width).astype(np.int64).view(np.uint64)
            h = (cell + np.uint64(dim)) * odd
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[at : at + 512] = h.reshape(-1, self.n_tables, self.k).sum(axis=2, dtype=np.uint64).view(np.int64)
        return out


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector in double precision; None if it is null, empty, zero or holds null or non-finite components."""
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    out = []
    for i in range(len(column)):
        v = values[ends[i] : ends[i + 1]]
        out.append(v if len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()  # so that squares neither overflow nor vanish
    return v / np.sqrt(v @ v)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k1, k2): a digest of the vector's components; null for vectors that link with nothing."""
    for batch in batches:
        keys = [None if v is None else np.frombuffer(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest(), dtype=np.int64) for v in _vectors(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([None if k is None else int(k[i]) for k in keys], pa.int64()) for i in (0, 1)]], names=["id", "k1", "k2"])


def table_keys(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [_unit(v) for v in _vectors(batch.column(1))]
            keys: list = [None] * len(units)
            for dim in {len(u) for u in units}:
                at = [i for i, u in enumerate(units) if len(u) == dim]
                for i, k in zip(at, tables.keys(np.stack([units[i] for i in at])), strict=True):
                    keys[i] = k
            ends = np.arange(len(units) + 1, dtype=np.int32) * tables.n_tables
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))], names=["rep", "keys"])

    return run


def compare_blocks(tables: Tables, threshold: float):
    """A function for mapInArrow over rows (t, key, i, j, side, rep, m, vec), sorted by the first four.

    Rows of one (t, key, i, j) are a block: side i of a key's members against side j, or
    side i against itself. Emits (a, b, n): with b, an edge of a spanning star of what
    links in the block; without, n linked vectors of a, counted in the first table whose
    key the two share. A block has at most twice SIDE rows or so; no pair is emitted.
    """

    def block(t: int, i: int, j: int, side: np.ndarray, rep: np.ndarray, m: np.ndarray, vecs: list[np.ndarray], out: list) -> None:
        x = np.stack([_unit(v) for v in vecs])
        if i == j:
            r, c = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        else:
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            r, c = np.nonzero(x[left] @ x[right].T >= threshold)
            r, c = left[r], right[c]
        if not len(r):
            return
        if t:
            used, back = np.unique(np.concatenate([r, c]), return_inverse=True)
            keys = tables.keys(x[used])
            kr, kc = back[: len(r)], back[len(r) :]
            for earlier in range(t):
                new = keys[kr, earlier] != keys[kc, earlier]
                r, c, kr, kc = r[new], c[new], kr[new], kc[new]
                if not len(r):
                    return
        linked = np.zeros(len(rep), dtype=np.int64)
        np.add.at(linked, r, m[c])
        np.add.at(linked, c, m[r])
        label, was = rep.copy(), None
        while was is None or (was != label).any():
            was = label.copy()
            np.minimum.at(label, r, label[c])
            np.minimum.at(label, c, label[r])
        for k in np.flatnonzero(linked):
            out.append((int(rep[k]), None, int(linked[k])))
            if label[k] != rep[k]:
                out.append((int(rep[k]), int(label[k]), None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def blocks(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            cols = [table.column(k).to_numpy() for k in range(7)]
            edge = np.zeros(len(table), dtype=bool)
            if len(table):
                edge[0] = True
            for col in cols[:4]:
                edge[1:] |= col[1:] != col[:-1]
            starts = [*np.flatnonzero(edge), len(table)]
            whole = starts if last else starts[:-1]
            vecs = _vectors(table.column(7).combine_chunks())
            out: list = []
            for lo, hi in zip(whole[:-1], whole[1:], strict=True):
                if hi - lo > 1:
                    block(int(cols[0][lo]), int(cols[2][lo]), int(cols[3][lo]), cols[4][lo:hi], cols[5][lo:hi], cols[6][lo:hi], vecs[lo:hi], out)
            made = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], names=["a", "b", "n"])
            return made, None if last or not len(table) else table.slice(starts[-2])

        for batch in batches:
            part = pa.Table.from_batches([batch])
            made, held = blocks(part if held is None else pa.concat_tables([held, part]), False)
            yield made
        if held is not None:
            yield blocks(held, True)[0]

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.97, seed: int = 9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, n_links (other vectors linked directly), component_id (least id reachable), kept (id = component).

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing and are kept; vectors of different length do not link. Null ids link with
    nothing and have no component. Equal vectors are one class before any are compared,
    so a vector that fills a third of the table costs one comparison. A key's members
    are cut into sides of some SIDE vectors, and each pair of sides is a task's block,
    so no key is gathered in one place. Repeated rows count as vectors; rows that share
    an id have one component. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    marked = materialize(rows.mapInArrow(describe, "id long, k1 long, k2 long"), "marked")
    classes = materialize(marked.where("k1 is not null and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "classes")
    owners = classes.select(F.col("rep").alias("id"), "m", "k1", "k2")
    keyed = rows.mapInArrow(describe_with_vector, f"id long, k1 long, k2 long, vec {vectors.schema[vec_col].dataType.simpleString()}")
    reps = materialize(keyed.join(owners, ["id", "k1", "k2"]).dropDuplicates(["id", "k1", "k2"]).select(F.col("id").alias("rep"), "m", "vec"), "reps")
    k, n_tables = parameters(reps.count(), threshold, recall)
    tables = Tables(k, n_tables, WIDTH, seed)

    keys = reps.select("rep", "vec").mapInArrow(table_keys(tables), "rep long, keys array<long>").select("rep", F.posexplode("keys").alias("t", "key"))
    keys = materialize(keys, "keys")
    shared = keys.groupBy("t", "key").agg(F.count("*").alias("members")).where("members > 1")
    sides = F.ceil(F.col("members") / SIDE).cast("int")
    placed = keys.join(shared, ["t", "key"]).withColumn("sides", sides).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("sides")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    placed = placed.withColumn("other", other).select("t", "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep")
    members = placed.join(reps, "rep").select("t", "key", "i", "j", "side", "rep", "m", "vec")
    block = ["t", "key", "i", "j"]
    found = members.repartition(*block).sortWithinPartitions(*block, "rep").mapInArrow(compare_blocks(tables, threshold), "a long, b long, n long")
    found = materialize(found, "found")
    comps = components(found.where("b is not null"))
    linked = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))

    out = marked.join(classes, ["k1", "k2"], "left").select("id", "k1", "rep", "m")
    out = out.join(linked, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    alone = F.col("id").isNull() | F.col("k1").isNull()
    links = F.when(alone, 0).otherwise(F.col("m") - 1 + F.coalesce("n", F.lit(0))).cast("long")
    component = F.when(alone, F.col("id")).otherwise(F.coalesce("component", "rep"))
    out = out.select(F.col("id").alias(id_col), links.alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def describe_with_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k1, k2, vec) of the vectors that can link."""
    for batch in batches:
        marked = next(describe(iter([batch])))
        ok = marked.column(1).is_valid()
        yield pa.RecordBatch.from_arrays([*marked.columns, batch.column(1)], names=["id", "k1", "k2", "vec"]).filter(ok)
