"""What operators once did less than wholly: all links, rare terms, long lengths, the rows of the mix."""

import collections
import itertools
import random

from pyspark.sql import functions as F
from test_llm_operators import frame, near_texts, sets_of

from webskein.llm import jaccard_join, packing, toxicity


def test_every_link_is_counted(spark):
    rows = near_texts(random.Random(21), 200)
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:40])]
    sets = sets_of(rows, 5)
    wanted = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            wanted[a] += 1
            wanted[b] += 1
    d = frame(spark, [(i, t, "en", "a") for i, t in rows] + [(None, rows[0][1], "en", "a"), (999, "", "en", "a")])
    found = {}
    kept = jaccard_join.SIDE, jaccard_join.COLUMNS
    for jaccard_join.SIDE, jaccard_join.COLUMNS in (kept, (5, 16)):
        found[jaccard_join.SIDE] = {r["doc_id"]: r["n_links"] for r in jaccard_join.jaccard_components(d).collect()}
    jaccard_join.SIDE, jaccard_join.COLUMNS = kept
    assert max(wanted.values()) > 5
    assert all(f == wanted | {None: 0, 999: 0} for f in found.values())


def test_rare_toxic_terms_are_learnt(spark, monkeypatch):
    """A term in few toxic rows is learnt however many harmless terms are more frequent there."""
    monkeypatch.setattr(toxicity, "CANDIDATES", 300, raising=False)
    rng = random.Random(22)
    rows, labels = [], []
    for i in range(1200):
        words = [f"harmless{rng.randrange(400)}x" for _ in range(60)] + [f"{rng.randrange(1 << 40):x}" for _ in range(200)]
        if i % 4 == 0:
            words[rng.randrange(60)] = "zounderkite" if i % 40 == 0 else "scoundrel"
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.learn(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.hit("scoundrel") and model.hit("zounderkite")
    assert not model.hit("harmless7x")


def test_long_lengths_have_least_padding(spark):
    """Near lengths beyond EXACT_LENGTHS are told apart."""
    d = spark.createDataFrame([(i, 10_003 if i == 5 else 10_000) for i in range(6)], "doc_id long, n long")
    got = packing.pack_batches(d, n_buckets=2, length=F.col("n")).collect()
    assert len(got) == 6 and sum(r["padding"] for r in got) == 0


def test_many_distinct_lengths_stay_exact(spark):
    """With more than 15,000 distinct lengths, two near ones beyond 4096 words still part where padding is least."""
    n = F.when(F.col("id") < 15_200, F.col("id") + 1).when(F.col("id") < 35_200, 100_000).otherwise(100_050)
    got = packing.pack_batches(spark.range(35_600).select("id", n.alias("n")), length=F.col("n"), id_col="id")
    uppers = {r.bucket_length for r in got.where("length >= 100000").select("bucket_length").distinct().collect()}
    assert uppers == {100_000, 100_050}


def test_batches_do_not_depend_on_lanes(spark, monkeypatch):
    """However many tasks number a bucket, its rows make the same batches, of which one at most is not full."""
    d = spark.range(5_000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("n"))
    runs = []
    for rows in (50_000, 300):
        monkeypatch.setattr(packing, "ROWS_PER_LANE", rows)
        runs.append(sorted(packing.pack_batches(d, n_buckets=2, batch_tokens=100, length=F.col("n")).collect()))
    assert runs[0] == runs[1] and len(runs[0]) == 5_000
    full = collections.Counter(r.batch for r in runs[1])
    for bucket, upper in {(r.bucket, r.bucket_length) for r in runs[1]}:
        assert sum(n < 100 // upper for b, n in full.items() if b.startswith(f"{bucket}-")) <= 1
