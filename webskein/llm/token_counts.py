"""Operator 6, token counts: rollups by source, language and tokenizer version, kept up by signed deltas.

A batch is a set of signed entries: an insert adds a document's tokens, a delete takes
away what was added, a revision does both. A batch is committed whole, under its name,
by one rename; committing a name again changes nothing, so a job that is run again after
a lost driver or executor counts nothing twice. Totals are sums of the batches' own
rollups, so they never look at documents again.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _path, materialize, word_count

ENTRY = ["doc_id", "source", "lang", "version", "docs", "tokens"]
GROUP = ["source", "lang", "version"]

# Fixed value: the pattern that splits text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class BytePairs:
    """A byte-level vocabulary in rank format. The driver reads it; executors get it with the task."""

    version: str
    path: str
    pattern: str = PATTERN

    def counter(self):
        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern, name = self.pattern, self.version

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import tiktoken

            made = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for batch in batches:
                n = [len(made.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokens"])

        return run

    def count(self, rows: DataFrame) -> DataFrame:
        schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "source", "lang"))
        return rows.select("doc_id", "source", "lang", "text").mapInArrow(self.counter(), f"{schema}, tokens long").withColumn("version", F.lit(self.version))


@dataclass(frozen=True)
class Words:
    """Words between blanks; with a pattern, the matches of that instead."""

    version: str
    pattern: str | None = None

    def count(self, rows: DataFrame) -> DataFrame:
        n: Column = word_count(F.col("text")) if self.pattern is None else F.coalesce(F.regexp_count("text", F.lit(self.pattern)), F.lit(0)).cast("long")
        return rows.select("doc_id", "source", "lang", n.alias("tokens"), F.lit(self.version).alias("version"))


def inserts(docs: DataFrame, tokenizer: BytePairs | Words) -> DataFrame:
    """Entries that add every row of docs (doc_id, source, lang, text). Null and empty texts add a document of 0 tokens."""
    rows = docs.select("doc_id", "source", "lang", "text")
    return tokenizer.count(rows).withColumn("docs", F.lit(1).cast("long")).select(ENTRY)


def deletes(entries: DataFrame) -> DataFrame:
    """Entries that take away the given ones."""
    return entries.withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")}).select(ENTRY)


class TokenLedger:
    """Batches of signed entries under a path that all executors share.

    batches/<name>/entries and batches/<name>/rollup are written beside and renamed into
    place together. A compaction folds the rollups of named batches into one table, again
    by one rename; batches that it names are then not read again for totals. The file
    system has to rename folders in one step, and to fail, or to move into the folder that
    is there, if the target exists, as HDFS and local disks do; an object store without
    such a rename needs a committer of its own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._make("batches")
        self._make("folded")

    def _make(self, name: str) -> None:
        made, fs = _path(self.spark, f"{self.path}/{name}")
        fs.mkdirs(made)

    def _names(self, name: str) -> list[str]:
        made, fs = _path(self.spark, f"{self.path}/{name}")
        return sorted(s.getPath().getName() for s in fs.listStatus(made) if not s.getPath().getName().startswith("_"))

    def batches(self) -> list[str]:
        return self._names("batches")

    def _publish(self, made: str, place: str) -> bool:
        """Rename into place, whole; False, and nothing is left behind, if another run was first."""
        source, fs = _path(self.spark, f"{self.path}/{made}")
        target, _ = _path(self.spark, f"{self.path}/{place}")
        done = not fs.exists(target) and fs.rename(source, target)
        # A rename onto a folder that has just come into being moves into it.
        inner, _ = _path(self.spark, f"{self.path}/{place}/{made}")
        if done and fs.exists(inner):
            fs.delete(inner, True)
            return False
        if not done:
            fs.delete(source, True)
        return done

    def commit(self, name: str, entries: DataFrame) -> bool:
        """Add a batch of entries, each with docs 1 or -1; False, and no change, if one of that name is there."""
        if name in self.batches():
            return False
        staged = f"_staged-{uuid.uuid4().hex}"
        entries.select(ENTRY).write.parquet(f"{self.path}/{staged}/entries")
        rollup = self.spark.read.parquet(f"{self.path}/{staged}/entries").groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        rollup.write.parquet(f"{self.path}/{staged}/rollup")
        return self._publish(staged, f"batches/{name}")

    def _entries(self) -> DataFrame | None:
        names = self.batches()
        return self.spark.read.parquet(*[f"{self.path}/batches/{b}/entries" for b in names]) if names else None

    def current(self, version: str | None = None) -> DataFrame:
        """The entries now in force: a row for each time a document is counted."""
        found = self._entries()
        if found is None:
            return self.spark.createDataFrame([], "doc_id long, source string, lang string, version string, docs long, tokens long")
        if version is not None:
            found = found.where(F.col("version") == version)
        # A group's rows cancel by sign; what is left of a revised document is its newest count.
        per = found.withColumn("each", F.col("tokens") * F.col("docs"))
        left = per.groupBy("doc_id", *GROUP, "each").agg(F.sum("docs").alias("docs")).where("docs > 0")
        # One row for each copy in force, as it was inserted.
        return left.withColumn("docs", F.explode(F.array_repeat(F.lit(1).cast("long"), F.col("docs").cast("int")))).select("doc_id", "source", "lang", "version", "docs", F.col("each").alias("tokens"))

    def totals(self, names: list[str] | None = None) -> DataFrame:
        """source, lang, version, docs, tokens over all batches, or over those of the given names and all that are folded;
        groups that have come to nothing are left out."""
        names = self.batches() if names is None else names
        folded = self._names("folded")[-1:]
        done = self._done(folded)
        parts = [f"{self.path}/folded/{f}/rollup" for f in folded]
        parts += [f"{self.path}/batches/{b}/rollup" for b in names if b not in done]
        if not parts:
            return self.spark.createDataFrame([], "source string, lang string, version string, docs long, tokens long")
        rows = self.spark.read.parquet(*parts).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return rows.where("docs <> 0 or tokens <> 0")

    def _done(self, folded: list[str]) -> set[str]:
        """The names of the batches that these compactions hold: a name a commit, not a row a document."""
        return {r["name"] for f in folded for r in self.spark.read.parquet(f"{self.path}/folded/{f}/names").collect()}

    def fold(self) -> None:
        """Fold the rollups of all batches there are now into one table. Batches are listed once: one that is committed
        while they are summed is in none of the two."""
        names = self.batches()
        if not names:
            return
        folded = self._names("folded")
        staged, n = f"_staged-{uuid.uuid4().hex}", len(folded)
        self.totals(names).write.parquet(f"{self.path}/{staged}/rollup")
        self.spark.createDataFrame([(b,) for b in sorted({*names, *self._done(folded[-1:])})], "name string").write.parquet(f"{self.path}/{staged}/names")
        self._publish(staged, f"folded/{n:06d}")


def token_rollup(docs: DataFrame, path: str, subwords: BytePairs | Words, words: Words, newer: Words) -> DataFrame:
    """The totals after the life of a corpus: loaded, loaded again by a retry, copies withdrawn, words counted anew.

    Batch "load" inserts every document under two tokenizers and is committed twice, the
    second time without effect. Batch "copies" deletes the documents whose text one of a
    smaller id has, by the entries that inserted them. Batch "recount" revises the counts of one tokenizer to those of its
    newer version. Returns source, lang, version, docs, tokens.

    Null texts are documents of 0 tokens and are no copies of each other; empty texts are
    copies. Null sources and languages are groups of their own. Rows that repeat an id are
    counted each and deleted together; rows without an id are never deleted. An empty
    table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ledger = TokenLedger(spark, path)
    rows = docs.select("doc_id", "source", "lang", "text")
    ledger.commit("load", inserts(rows, subwords).unionByName(inserts(rows, words)))
    ledger.commit("load", inserts(rows, words))

    first = rows.where("text is not null and doc_id is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    again = rows.select("doc_id", F.sha2("text", 256).alias("digest")).join(first.where("n > 1"), "digest").where("doc_id > first")
    gone = materialize(again.select("doc_id").distinct(), "gone")
    ledger.commit("copies", deletes(ledger.current().join(gone, "doc_id", "left_semi")))
    ledger.fold()

    old = ledger.current(words.version)
    ledger.commit("recount", deletes(old).unionByName(inserts(rows, newer).join(gone, "doc_id", "left_anti")))
    return ledger.totals()
