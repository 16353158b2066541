"""Operator 1, n-gram Jaccard join by prefix filters under several global token orders.

A document is the set of its distinct word shingles, as 64-bit hashes. Two sets link when
their Jaccard similarity reaches percent / 100. Sets that link share a token among the
first few of each set, its prefix, under any one total order of all tokens. There are
three orders: in the first, frequent tokens are last; the other two are of hashes. Every
candidate comes from postings of the first order, at places that leave room for enough
shared tokens, and goes on only if the prefixes under the second and the third order meet,
too; an odd sketch of each set (the parity of its tokens' counts in cells) bounds the
symmetric difference from below and drops what cannot link. All that is done on numbers;
only the texts of what is left are moved and compared exactly.

Only links between different sets matter, so
1. documents with equal sets are one class, a node;
2. each class is held against two of its postings that have most others beside them, which
   settles large groups of near copies with few comparisons;
3. the rest of the postings is then looked at between what is still apart, so no link that
   joins two components is lost, and pairs within a component are never made.

All links are within components. How many a document has is counted inside each component,
in blocks: every class is held as its difference from the component's first class, few
numbers for near copies, and the difference of two classes is that of their differences.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, small, small_batches

#: Frequent tokens that go last in the first order: a bounded table (8 MB), which costs or saves time only.
FREQUENT_TOKENS = 1 << 19
#: Tokens counted at once in a task, and the count there from which a token is reported.
COUNTED_TOKENS, REPORTED = 1 << 21, 3
#: Rows of up to 40 bytes that are broadcast; beyond it rows are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Classes of a list of postings that all others are held against first.
PIVOTS = 4
#: Texts that one task compares with one center.
LANE_TEXTS = 64
#: Classes, and shingles in their differences, on one side of a block, more or less; shingles that are multiplied at once.
SIDE, SIDE_SHINGLES, COLUMNS = 512, 1 << 20, 4096
#: Cells of the least sketch; a larger set has half as many cells as shingles, or up to as many.
CELLS = 512
_SEGMENT = 1 << 21
_P = 0x9E3779B97F4A7C15
#: Multipliers that make the second and third order and the sketch.
_ODD = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct shingle hashes of texts; words are runs of bytes other than blanks, letters A-Z in lower case.

    A word's hash is a polynomial over its bytes, taken for all words of a piece of text
    at once from running sums; memory is bounded by the piece, not by the text.
    """

    def __init__(self, shingle: int):
        self.shingle = shingle
        self.power = np.cumprod(np.full(1024, _P, dtype=np.uint64))
        self.inverse = np.cumprod(np.full(1024, pow(_P, -1, 1 << 64), dtype=np.uint64))
        self.blank = np.zeros(256, dtype=bool)
        self.blank[[32, 9, 10, 11, 12, 13]] = True

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            self.power = np.cumprod(np.full(2 * n, _P, dtype=np.uint64))
            self.inverse = np.cumprod(np.full(2 * n, pow(_P, -1, 1 << 64), dtype=np.uint64))

    def words(self, text: bytes) -> np.ndarray:
        out, at, step = [], 0, _SEGMENT
        while at < len(text):
            piece = np.frombuffer(text, dtype=np.uint8, count=min(step, len(text) - at), offset=at)
            gap = self.blank[piece]
            if at + len(piece) < len(text) and not gap[-1]:
                blanks = np.flatnonzero(gap)
                if not len(blanks):  # a word longer than the piece
                    step *= 2
                    continue
                piece, gap = piece[: blanks[-1] + 1], gap[: blanks[-1] + 1]
            at, step = at + len(piece), _SEGMENT
            self._grow(len(piece) + 1)
            edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
            start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * self.power[: len(piece)])])
            out.append(_mix((run[end] - run[start]) * self.inverse[start] + (end - start).astype(np.uint64)))
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)

    def set_of(self, text: bytes | None) -> np.ndarray:
        """Ascending distinct shingle hashes; fewer words than a shingle: the whole sequence as one."""
        w = self.words((text or b"").lower())
        if not len(w):
            return w
        size = min(self.shingle, len(w))
        h = np.full(len(w) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            h = h * np.uint64(_P) + w[i : len(w) - size + 1 + i]
        return np.unique(_mix(h))


def prefix_length(n: int, percent: int) -> int:
    """So many tokens, the first under any order, hold one of each set that links with this one."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketch_of(s: np.ndarray) -> np.ndarray:
    """The odd sketch of a set, a power of two of cells, 64 in a number; halves folded together by exclusive or
    are the sketch of half as many cells."""
    cells = CELLS
    while 2 * cells < len(s):
        cells *= 2
    odd = np.bincount((_mix(s * np.uint64(_ODD[3])) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, kind), type=pa.from_numpy_dtype(kind)))


def _digest(s: np.ndarray) -> np.ndarray:
    """The two numbers that tell a set from others."""
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)


SETS = "id long, th long, n long, k1 long, k2 long, token long, seen long"


def describe_sets(shingle: int):
    """A function for mapInArrow over (id, th, body): a row for each document, and rows (token, seen) of tokens that are not rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(shingle)
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            token, seen = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            token, seen = token[seen >= REPORTED], seen[seen >= REPORTED]
            none = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(_signed(token)), pa.array(seen.astype(np.int64))], names=["id", "th", "n", "k1", "k2", "token", "seen"])

        for batch in batches:
            ns, keys = [], []
            for text in batch.column(2):
                s = make.set_of(text.as_py())
                ns.append(len(s))
                keys.append(_digest(s))
                held.append(s)
                size += len(s)
                if size >= COUNTED_TOKENS:
                    yield counted()
                    held, size = [], 0
            none = pa.nulls(len(ns), pa.int64())
            k = np.array(keys, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), none, none], names=["id", "th", "n", "k1", "k2", "token", "seen"])
        yield counted()

    return run


HEADS = "id long, k1 long, k2 long, sketch array<long>, first array<long>, second array<int>, third array<int>"


def prefixes(shingle: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]):
    """A function for mapInArrow over (id, body): what the filters need of each set that is not empty.

    first: the prefix under the first order, in that order: tokens that are not frequent
    by hash, then frequent ones from the least frequent on; second and third: prefixes
    under the other orders, 32 bits of each token, which may only let more pairs pass.
    frequent: ascending hashes, and the place of each.
    """
    known, place = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(shingle)
        for batch in batches:
            ids, keys, sketches, parts = [], [], [], ([], [], [])
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                s = make.set_of(text.as_py())
                p = prefix_length(len(s), percent)
                if not p:
                    continue
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    late = known[at] == s
                    first = s[~late][:p]
                    if len(first) < p:
                        rest = s[late][np.argsort(place[at[late]], kind="stable")]
                        first = np.concatenate([first, rest[: p - len(first)]])
                else:
                    first = s[:p]
                ids.append(i.as_py())
                keys.append(_digest(s))
                sketches.append(sketch_of(s))
                parts[0].append(_signed(first))
                for out, odd in zip(parts[1:], _ODD[1:3], strict=True):
                    head = s[np.argpartition(_mix(s * np.uint64(odd)), p - 1)[:p]]
                    out.append((head & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
            k = np.array(keys, dtype=np.int64).reshape(-1, 2)
            cols = [pa.array(ids, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), _lists(sketches), _lists(parts[0]), _lists(parts[1], np.int32), _lists(parts[2], np.int32)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "k1", "k2", "sketch", "first", "second", "third"])

    return run


def links(na: int, nb: int, apart: int, percent: int) -> bool:
    """Whether sets of these sizes, with so many tokens in one of them only, reach the similarity."""
    return (100 - percent) * (na + nb) >= (100 + percent) * apart


def compare_with_centers(shingle: int, percent: int, differences: bool):
    """A function for mapInArrow over rows (a, lane, b, k1, k2, body) sorted by a, lane and b, nulls first: the text
    of a center, b null, then those that are compared with it. Emits the pairs (a, b) that link; with differences
    every pair, and the tokens that are in one of the two sets only.

    k1 and k2 are the digest of the set that is meant; a text whose set is another, as rows
    that share an id may have, is passed over. Only two sets are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, at, center = Shingler(shingle), None, None
        for batch in batches:
            out, parts = [], []
            for a, lane, b, k1, k2, body in zip(*batch.columns, strict=True):
                a, lane, b = a.as_py(), lane.as_py(), b.as_py()
                if b is None and at == (a, lane):
                    continue
                s = make.set_of(body.as_py())
                if tuple(_digest(s)) != (k1.as_py(), k2.as_py()):
                    continue
                if b is None:
                    at, center = (a, lane), s
                elif at == (a, lane):
                    both = np.concatenate([center, s])
                    both.sort(kind="stable")
                    same = both[1:] == both[:-1]
                    if differences:
                        once = np.ones(len(both), dtype=bool)
                        once[1:] &= ~same
                        once[:-1] &= ~same
                        out.append((a, b))
                        parts.append(_signed(both[once]))
                    elif links(len(center), len(s), len(both) - 2 * int(same.sum()), percent):
                        out.append((a, b))
            cols = [pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, _lists(parts)] if differences else cols, names=["a", "b", "apart"][: 2 + differences])

    return run


def linked_rows(apart: list[np.ndarray], sizes: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """For each class the sum of m over the classes that link with it, of pairs between left and right (places); left
    and right the same: of all pairs. apart: the differences from one common set. Exact: what two differences share
    is counted as products of 0/1 matrices."""
    own = np.array([len(d) for d in apart], dtype=np.int64)
    _, place, times = np.unique(np.concatenate(apart), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(apart)), own), times > 1
    kept = often[place]
    place, row = (np.cumsum(often) - 1)[place[kept]], row[kept]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    same = left is right
    shared = np.zeros((len(left), len(right)))
    for lo in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(place, (lo, lo + COLUMNS))
        x = np.zeros((len(apart), COLUMNS), dtype=np.float32)
        x[row[a:b], place[a:b] - lo] = 1
        shared += x[left] @ x[right].T
    between = own[left][:, None] + own[right][None, :] - 2 * shared
    link = (100 - percent) * (sizes[left][:, None] + sizes[right][None, :]) >= (100 + percent) * between
    out = np.zeros(len(apart), dtype=np.int64)
    if same:
        np.fill_diagonal(link, False)
    else:
        out[right] = m[left] @ link
    out[left] = link @ m[right]
    return out


def count_in_blocks(percent: int):
    """A function for mapInArrow over rows (comp, i, j, side, node, n, m, apart) sorted by comp, i and j.

    Rows of one (comp, i, j) are a block: side i of a component's classes against side j,
    or side i against itself. Emits (node, others): so many rows of other classes link
    with this class. The differences of one block are held.
    """

    def block(at: tuple, held: dict, out: list) -> None:
        if len(held) < 2:
            return
        side, n, m, apart = (list(c) for c in zip(*held.values(), strict=True))
        left = np.flatnonzero(np.array(side) == at[1])
        right = left if at[1] == at[2] else np.flatnonzero(np.array(side) == at[2])
        if len(left) and len(right):
            found = linked_rows(apart, np.array(n, dtype=np.int64), np.array(m, dtype=np.int64), left, right, percent)
            out.extend((node, int(k)) for node, k in zip(held, found, strict=True) if k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, {}, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(2)], names=["node", "others"])

        for batch in batches:
            numbers = [c.to_pylist() for c in batch.columns[:7]]
            for k, (comp, i, j, side, node, n, m) in enumerate(zip(*numbers, strict=True)):
                if at != (comp, i, j):
                    if at:
                        block(at, held, out)
                    at, held = (comp, i, j), {}
                held[node] = side, n, m, batch.column(7)[k].values.to_numpy().copy()
            yield made()
            out = []
        if at:
            block(at, held, out)
        yield made()

    return run


class Join:
    """The steps of one join; texts: id, th (a hash of the text), body, all of them read more than once."""

    def __init__(self, texts: DataFrame, shingle: int, percent: int):
        self.texts, self.shingle, self.percent = texts, shingle, percent

    def gathered(self, pairs: DataFrame, differences: bool = False) -> DataFrame:
        """The pairs (a, b) of classes, given as stored rows, that link, or all with their differences. A pair moves
        one text, b's, to its center a; a center of many pairs is several lanes, each with a copy of its text."""
        nodes = self.classes.select("node", "id", "k1", "k2")
        per = pairs.groupBy("a").agg(F.ceil(F.count("*") / LANE_TEXTS).cast("int").alias("lanes"))
        lane = F.pmod(F.xxhash64("b"), F.col("lanes")).cast("int").alias("lane")
        moved = pairs.join(per, "a").select("a", lane, "b", F.col("b").alias("node"))
        centers = per.select("a", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
        wanted = materialize(moved.unionByName(centers).join(nodes, "node").drop("node"), "wanted")
        rows = self.texts.join(small(wanted, BROADCAST_ROWS), "id").select("a", "lane", "b", "k1", "k2", "body")
        rows = rows.repartition("a", "lane").sortWithinPartitions("a", "lane", F.col("b").asc_nulls_first())
        return materialize(rows.mapInArrow(compare_with_centers(self.shingle, self.percent, differences), "a long, b long" + ", apart array<long>" * differences), "compared").dropDuplicates(["a", "b"])

    def filtered(self, pairs: DataFrame, name: str) -> DataFrame:
        """The stored pairs (a, b) that the sketches and the second and third order leave."""
        pairs = materialize(pairs, name)

        def beside(rows: DataFrame, by: str, cols: list[str]) -> DataFrame:
            """(a, b) with those columns of class a or b, as <column><a or b>."""
            return self.heads.select(F.col("node").alias(by), *[F.col(c).alias(c + by) for c in cols]).join(rows, by)

        few = small(pairs, BROADCAST_ROWS)
        near = beside(few, "a", ["n", "sketch"]).join(beside(few, "b", ["n", "sketch"]), ["a", "b"])
        near = materialize(near.where(may_link(self.percent)).select("a", "b").distinct(), f"{name}-near")
        few = small(near, BROADCAST_ROWS)
        meet = beside(few, "a", ["second", "third"]).join(beside(few, "b", ["second", "third"]), ["a", "b"])
        meet = meet.where(F.arrays_overlap("seconda", "secondb") & F.arrays_overlap("thirda", "thirdb"))
        return materialize(meet.select("a", "b").distinct(), f"{name}-meet")

    def room(self) -> Column:
        """Whether sets of sizes n and n_, of which so much as left and left_ comes from their first common token on, can share enough."""
        return F.least("left", "left_").cast("long") * (100 + self.percent) >= self.percent * (F.col("n").cast("long") + F.col("n_"))

    def components(self) -> DataFrame:
        """(node, component) of the classes that link with others; stores sets, classes and heads on the way."""
        described = materialize(self.texts.mapInArrow(describe_sets(self.shingle), SETS), "described")
        # The most frequent tokens, from the rarest on: a table of FREQUENT_TOKENS rows at most.
        top = described.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(FREQUENT_TOKENS).toPandas()
        known = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
        by_hash = np.argsort(known)
        frequent = known[by_hash], (-np.arange(len(known)))[by_hash]

        # 1. classes of equal sets, each with a number of its own and a row that stands for it
        self.sets = described.where("n is not null").select("id", "th", "n", "k1", "k2")
        per_id = self.sets.where("n > 0 and id is not null").groupBy("k1", "k2", "id").agg(F.count("*").alias("c"), F.first("n").alias("n"))
        grouped = per_id.groupBy("k1", "k2").agg(F.min(F.struct("id", "c")).alias("least"), F.sum("c").alias("m"), F.first("n").alias("n"))
        self.classes = materialize(grouped.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "least.id", (F.col("least.c") > 1).alias("again"), "m", "n"), "classes")
        own = small(self.classes.select("id", "k1", "k2", "node", "n", "again"), BROADCAST_ROWS)
        made = self.texts.select("id", "body").join(small(self.classes.select("id"), BROADCAST_ROWS), "id", "left_semi")
        made = made.mapInArrow(prefixes(self.shingle, self.percent, frequent), HEADS)
        heads = made.join(own, ["id", "k1", "k2"]).select("node", "n", "again", "sketch", "first", "second", "third")
        heads = materialize(heads, "heads")
        # Rows that repeat an id and its set are one.
        self.heads = heads.where("not again").unionByName(heads.where("again").dropDuplicates(["node"])) if heads.where("again").limit(1).count() else heads

        # 2. each class against classes that share many postings with others
        posts = self.heads.select("node", F.col("n").cast("int").alias("n"), F.posexplode("first").alias("at", "token"))
        shared = posts.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
        posts = materialize(posts.join(shared, "token", "left_semi"), "shared")
        # Tokens whose postings are the same, such as those of one passage, are one list, at their first place in each set.
        lists = posts.groupBy("token").agg(F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("nodes")).select("token", F.xxhash64("nodes").alias("list"))
        posts = materialize(posts.join(lists, "token").groupBy("list", "node").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.count("*").alias("tokens")), "posts")
        linked = self.gathered(self.filtered(self.near_pivots(posts), "pivots"))
        merged = components(linked)

        # 3. the postings between what is still apart
        posts = self.apart(posts, merged)
        # Two classes have room for enough common tokens if each has it for the size of the other. So classes of one size
        # and component are paired by the one with most room, and of those only classes that have it themselves are taken.
        spare = (100 + self.percent) * (F.col("n") - F.col("at")).cast("long") - self.percent * F.col("n").cast("long")
        posts = posts.withColumn("spare", spare)
        best = posts.groupBy("list", "comp", "band", "n").agg(F.max("spare").alias("spare"))
        near = best.withColumn("other", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
        mutual = (F.col("spare") >= self.percent * F.col("n_").cast("long")) & (F.col("spare_") >= self.percent * F.col("n").cast("long"))
        both = near.join(best.toDF("l_", "comp_", "band_", "n_", "spare_"), (F.col("list") == F.col("l_")) & (F.col("other") == F.col("band_")) & (F.col("comp") < F.col("comp_")) & mutual)
        one = posts.select(F.col("list").alias("l1"), F.col("comp").alias("c1"), F.col("n").alias("n1"), F.col("node").alias("a"), F.col("spare").alias("s1"))
        mine = (F.col("list") == F.col("l1")) & (F.col("comp") == F.col("c1")) & (F.col("n") == F.col("n1")) & (F.col("s1") >= self.percent * F.col("n_").cast("long"))
        one = both.select("list", "comp", "n", "comp_", "n_").join(one, mine).select("list", "n", "comp_", "n_", "a")
        two = posts.select(F.col("list").alias("l2"), F.col("comp").alias("c2"), F.col("n").alias("n2"), F.col("node").alias("b"), F.col("spare").alias("s2"))
        theirs = (F.col("list") == F.col("l2")) & (F.col("comp_") == F.col("c2")) & (F.col("n_") == F.col("n2")) & (F.col("s2") >= self.percent * F.col("n").cast("long"))
        cross = one.join(two, theirs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = self.gathered(self.filtered(cross, "cross"))
        if not more.limit(1).count():
            return merged
        return components(merged.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    def near_pivots(self, posts: DataFrame) -> DataFrame:
        """(a, b): of the pivots of its lists, PIVOTS a list, the one that shares most tokens with each class b, and the
        one that most classes are beside. A pivot is a class that has many others in its lists, as the text has from
        which a group of near copies was made."""
        lists = posts.groupBy("list").agg(F.count("*").alias("c"))
        known = posts.join(lists, "list").groupBy("node").agg(F.sum(F.col("c") * F.col("tokens")).alias("beside"))
        weighed = materialize(posts.join(known, "node"), "weighed")
        lane = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
        pivots = weighed.groupBy("list", lane).agg(F.max(F.struct("beside", "node", "n", "at")).alias("p"))
        pivots = pivots.select("list", F.col("p.node").alias("a"), F.col("p.beside").alias("beside_"), F.col("p.n").alias("n_"), (F.col("p.n") - F.col("p.at")).alias("left_"))
        near = weighed.withColumn("left", F.col("n") - F.col("at")).join(pivots, "list").where((F.col("node") != F.col("a")) & self.room()).groupBy("node", "a", "beside_").agg(F.sum("tokens").alias("shared"))
        best = near.groupBy(F.col("node").alias("b")).agg(F.max_by("a", F.struct("beside_", "a")).alias("x"), F.max_by("a", F.struct("shared", "beside_", "a")).alias("y"))
        return best.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), "b")

    def apart(self, posts: DataFrame, merged: DataFrame) -> DataFrame:
        """The postings of lists that hold more than one component, with the component."""
        posts = posts.join(small(merged, BROADCAST_ROWS), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        lists = posts.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("list")
        # Sets that link are of the same band of sizes, or of neighbouring ones.
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / self.percent + 1e-9))
        return materialize(posts.join(lists, "list", "left_semi").withColumn("band", band), "apart")

    def others(self, found: DataFrame) -> DataFrame:
        """(node, others): rows of other classes that link with each class of the components found."""
        members = materialize(found.join(self.classes.select("node", "n", "m"), "node"), "members")
        groups = members.groupBy("component").agg(F.count("*").alias("c"), F.sum("m").alias("all"))
        members = members.join(groups, "component")
        pair = members.where("c = 2").select("node", (F.col("all") - F.col("m")).alias("others"))
        members = materialize(members.where("c > 2").select("node", "component", "n", "m"), "larger")
        # The component is its first class, whose difference from itself is empty.
        apart = materialize(self.gathered(members.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")), differences=True), "differences")
        apart = apart.select(F.col("b").alias("node"), "apart").unionByName(members.where("node = component").select("node", F.array().cast("array<long>").alias("apart")))
        known = materialize(members.join(apart, "node"), "known")
        sides = known.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / SIDE), F.ceil(F.sum(F.size("apart")) / SIDE_SHINGLES)).cast("int").alias("sides"))
        placed = known.join(small(sides, BROADCAST_ROWS), "component").withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        block = ["comp", "i", "j"]
        placed = placed.select(F.col("component").alias("comp"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "n", "m", "apart")
        counted = placed.repartition(*block).sortWithinPartitions(*block).mapInArrow(count_in_blocks(self.percent), "node long, others long")
        return pair.unionByName(materialize(counted, "inside").groupBy("node").agg(F.sum("others").alias("others")))


def folded(sketch: Column, words: Column) -> Column:
    """The sketch with so many numbers, a power of two up to its own."""
    def cell(j: Column) -> Column:
        return F.aggregate(F.sequence(j, F.size(sketch) - 1, words), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.get(sketch, k)))

    return F.when(F.size(sketch) == words, sketch).otherwise(F.transform(F.sequence(F.lit(0), words - 1), cell))


def may_link(percent: int) -> Column:
    """Size filter and odd-sketch bound for rows with na, nb, sketcha, sketchb."""
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    words = F.least(F.size("sketcha"), F.size("sketchb"))
    cells = F.zip_with(folded(F.col("sketcha"), words), folded(F.col("sketchb"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    distance = F.aggregate(cells, F.lit(0), lambda acc, x: acc + x)
    return (100 * low >= percent * high) & ((100 + percent) * distance <= (100 - percent) * (F.col("na") + F.col("nb")))


def joined_rows(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, count: bool) -> DataFrame:
    """id, th (a hash of the text), n, comp (a number of the component, null for rows that link with nothing), class_id,
    component_id and, if asked for, n_links; a row for each of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("body"))
    join = Join(texts, shingle, percent)
    with small_batches(docs.sparkSession):
        found = join.components()
        known = join.classes.join(small(found, BROADCAST_ROWS), "node", "left").withColumn("comp", F.coalesce("component", "node"))
        if count:
            others = materialize(join.others(found), "others")
            known = known.join(small(others, BROADCAST_ROWS), "node", "left")
        known = materialize(known.select("k1", "k2", F.col("id").alias("class_id"), "comp", "m", *(["others"] if count else [])), "joined")
    known = known.join(known.groupBy("comp").agg(F.min("class_id").alias("component_id")), "comp")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    out = join.sets.join(small(materialize(known, "known"), BROADCAST_ROWS), ["k1", "k2"], "left")
    own = lambda c: F.when(alone, F.col("id")).otherwise(F.col(c)).alias(c)
    n_links = [F.when(alone, 0).otherwise(F.col("m") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links")] if count else []
    return out.select("id", "th", "n", F.when(~alone, F.col("comp")).alias("comp"), own("class_id"), own("component_id"), *n_links)


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, class_id (least id with the same set), component_id (least id reachable by links) and
    n_links, the number of other rows whose sets link with the row's.

    A text without words has an empty set and links with nothing, so do null ids; the
    class and component of the former are its own id, of the latter null. Rows that share
    an id but not their set are told apart; those that share both are repeats, which
    link with each other. Repeated rows return repeated; an empty table gives no rows;
    other columns are not read. Texts are read several times; only those of pairs that
    pass all filters are shuffled.
    """
    rows = joined_rows(docs, shingle, percent, id_col, text_col, True)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id", "n_links")


def keep_one_each(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, without those that another row stands for.

    Of each component one row stays: of the rows of its least id the one of the least text
    hash, any one of them if they repeat. Texts without words and rows without an id all stay.
    An empty table gives no rows.
    """
    rows = joined_rows(docs, shingle, percent, id_col, text_col, False).where("comp is not null")
    rows = materialize(rows.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "comp", "component_id"), "found")
    # Ids of more than one row are looked at by their texts, too.
    again = materialize(rows.groupBy("__id").agg(F.count("*").alias("c")).where("c > 1").select("__id"), "again")
    apart = materialize(rows.where("component_id <> __id").select("__id").unionByName(again).distinct(), "apart")
    same = F.col(id_col) == F.col("__id")
    once = docs.join(small(apart, BROADCAST_ROWS), same, "left_anti")
    if not again.limit(1).count():
        return once
    own = materialize(rows.join(again, "__id", "left_semi").distinct(), "own")
    stays = own.where("component_id = __id").groupBy("__id", "comp").agg(F.min("__th").alias("__th")).select("__id", "__th").distinct()
    repeats = docs.join(small(again, BROADCAST_ROWS), same, "left_semi").withColumn("__hash", F.xxhash64(text_col))
    text = same & (F.col("__hash") == F.col("__th"))
    blank = repeats.join(own.select("__id", "__th").distinct(), text, "left_anti")
    one = repeats.join(stays, text, "left_semi").dropDuplicates([id_col, "__hash"])
    return once.unionByName(blank.unionByName(one).drop("__hash"))
