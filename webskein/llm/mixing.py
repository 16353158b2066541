"""Operator 3, mixing sources to target weights by Sainte-Lague apportionment.

All steps are DataFrame operations. The words of a source form a stream, cut into
blocks of nearly equal size; the mix is so many blocks, apportioned to sources by
highest quotients and then, again by highest quotients, to the shards of each source.
A shard takes whole passes over its blocks and, for the rest, a seeded choice of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, seeded, word_count

WEIGHTS = (5, 2, 1)
#: A source is used at most this many times over.
MOST_PASSES = 3
#: Words of one shard of the streams; block sizes follow the input so that there are some 260,000 blocks, up to MOST_BLOCK words each.
SHARD_WORDS, BLOCKS, LEAST_BLOCK, MOST_BLOCK = 4_000_000, 1 << 18, 16, 4096


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, passes: int = MOST_PASSES) -> DataFrame:
    """Target words of each source; sources: source, words, one row a source.

    Weights repeat over the sources in code point order, null last. All sources share
    share * the words of all; a target stops at passes * its source's words and the
    excess is reshared by weight until none is above. That fixed point is a water level:
    in order of passes * words / weight, the sources up to some place are full, and what
    they leave is shared by weight among the rest.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    cap = (F.col("words") * passes).cast("double")
    weighed = sources.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)).withColumn("__cap", cap)
    by_level = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), "source")
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = weighed.select(
        "*",
        (F.lit(share) * F.sum("words").over(everything)).alias("__all"),
        F.coalesce(F.sum("__cap").over(below), F.lit(0.0)).alias("__full"),
        (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(below), F.lit(0.0))).alias("__rest"),
    )
    level = (F.col("__all") - F.col("__full")) / F.col("__rest")
    # The level of the first source that the water does not fill holds for all after it.
    run = run.withColumn("__level", F.when(level * F.col("__w") <= F.col("__cap"), level))
    first = F.first("__level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return run.withColumn("target", F.coalesce(F.least(first * F.col("__w"), F.col("__cap")), F.col("__cap"))).select("source", "words", "target")


def apportion(parties: DataFrame, seats: str, votes: str, group: list[str], tie: list[Column], out: str) -> DataFrame:
    """Sainte-Lague: seats of each group dealt to its parties by the highest quotients votes / (2k + 1).

    parties: rows with a group, its number of seats, and votes >= 0. The divisor at which
    votes / divisor, rounded, make up all seats is off from votes / seats by no more than
    the rounding of all parties, so a party's seats differ from its share by half a seat
    and its part of half the number of parties. Only the quotients in that range are
    made and ranked, some two or three a party; those below it are won for certain.
    Equal quotients go by the order in tie.
    """
    over = Window.partitionBy(*group)
    sized = parties.withColumn("__share", F.when(F.sum(votes).over(over) > 0, F.col(seats) * F.col(votes) / F.sum(votes).over(over)).otherwise(0.0))
    half = F.sum(F.when(F.col(votes) > 0, 0.5).otherwise(0.0)).over(over)
    sized = sized.withColumn("__reach", F.when(F.col(seats) > 0, F.col("__share") * half / F.col(seats)).otherwise(0.0) + 0.75)
    sized = sized.withColumn("__sure", F.greatest(F.lit(0), F.floor(F.col("__share") - F.col("__reach"))).cast("long"))
    sized = sized.withColumn("__most", F.when((F.col(votes) > 0) & (F.col(seats) > 0), F.ceil(F.col("__share") + F.col("__reach"))).otherwise(0).cast("long"))
    left = F.col(seats) - F.sum("__sure").over(over)
    offers = sized.withColumn("__left", left).withColumn("__k", F.explode_outer(F.when(F.col("__most") > F.col("__sure"), F.sequence("__sure", F.col("__most") - 1))))
    quotient = F.col(votes) / (2 * F.col("__k") + 1)
    rank = F.row_number().over(over.orderBy(quotient.desc_nulls_last(), *tie, F.col("__k")))
    won = offers.withColumn("__won", (F.col("__k").isNotNull() & (rank <= F.col("__left"))).cast("long"))
    keep = parties.columns
    return won.groupBy(*[F.col(c) for c in keep], "__sure").agg(F.sum("__won").alias("__extra")).select(*keep, (F.col("__sure") + F.col("__extra")).alias(out))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_words: int = SHARD_WORDS) -> DataFrame:
    """How many words of each document the mix takes.

    Returns id_col, source_col, text_hash, size (words of the text), source_size, target (of its
    source), passes (whole passes over its shard), part (words of the further, partial
    pass), taken (passes * size + part, at most three times size).

    Null and empty texts have size 0 and give 0; a source without words has target 0;
    null sources are one source, last in order; null ids are rows like others; repeated
    rows each count. An empty table gives no rows. Two runs agree: the order of a stream
    and the choice of blocks are hashes of the seed, ids and texts. Texts are read once;
    from there only ids, sources, sizes and hashes move. A hot source is split into shards.
    """
    rows = materialize(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("__text")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("words"))
    total = sources.agg(F.sum("words")).first()[0] or 0
    n_shards = max(1, -(-total // shard_words))
    block = min(MOST_BLOCK, max(LEAST_BLOCK, total // BLOCKS))

    shard = F.pmod(seeded(seed, F.col("__id"), F.col("__text")), F.lit(n_shards)).cast("long")
    cells = rows.groupBy("source", shard.alias("shard")).agg(F.sum("size").alias("cell_words"))
    cells = cells.withColumn("blocks", F.when(F.col("cell_words") > 0, F.greatest(F.lit(1), F.round(F.col("cell_words") / block))).otherwise(0).cast("long"))
    cells = materialize(cells, "cells")

    # A source's votes are its target in blocks of its own, so that seats times block is its target.
    goal = targets(cells.groupBy("source").agg(F.sum("cell_words").alias("words")), weights)
    own = cells.groupBy(F.col("source").alias("__s")).agg(F.sum("blocks").alias("source_blocks"))
    goal = goal.join(own, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    goal = goal.withColumn("votes", F.when(F.col("words") > 0, F.col("target") * F.col("source_blocks") / F.col("words")).otherwise(0.0))
    goal = goal.withColumn("one", F.lit(1)).withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy("one"))).cast("long"))
    by_name = [F.col("source").isNull(), F.col("source")]
    goal = apportion(goal, "seats", "votes", ["one"], by_name, "quota").select("source", F.col("words").alias("source_size"), "target", "quota")
    goal = materialize(goal, "targets")

    quotas = cells.join(goal.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    quotas = apportion(quotas, "quota", "blocks", ["source"], [F.col("shard")], "cell_quota")
    whole = F.when(F.col("blocks") > 0, F.least(F.lit(MOST_PASSES), F.floor(F.col("cell_quota") / F.col("blocks")))).otherwise(0).cast("long")
    quotas = quotas.withColumn("passes", whole)
    quotas = quotas.withColumn("chosen", F.when(F.col("passes") >= MOST_PASSES, 0).otherwise(F.col("cell_quota") - F.col("passes") * F.col("blocks")))
    quotas = materialize(quotas, "quotas")

    # The blocks of the partial pass: the least seeded hashes of each shard; block j covers
    # the words from floor(j * words / blocks) on.
    block_of = quotas.where("chosen > 0").select("source", "shard", "cell_words", "blocks", "chosen", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    draw = Window.partitionBy("source", "shard").orderBy(seeded(seed + 1, F.col("source"), F.col("shard"), F.col("block")), "block")
    picked = block_of.withColumn("__r", F.row_number().over(draw)).where("__r <= chosen").select("source", "shard", "block")

    stream = Window.partitionBy("source", "shard").orderBy(seeded(seed + 2, F.col("__id"), F.col("__text")), "__id", "__text", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("shard", shard).withColumn("end", F.sum("size").over(stream)).withColumn("start", F.col("end") - F.col("size"))
    q = quotas.select(F.col("source").alias("__s"), F.col("shard").alias("__sh"), "cell_words", "blocks", "source_size", "target", "passes", "chosen")
    placed = placed.join(q, F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__sh"))).drop("__s", "__sh")
    # A block's bounds are exact integers: the words before block j are j * words div blocks.
    placed = placed.withColumn("__row", F.monotonically_increasing_id())
    placed = materialize(placed, "placed")
    first = F.expr("start * blocks div cell_words")
    last = F.expr("(end * blocks - 1) div cell_words")
    spans = placed.where("chosen > 0 and size > 0").select("__row", "source", "shard", "start", "end", "cell_words", "blocks", F.explode(F.sequence(F.greatest(F.lit(0), first - 1), F.least(last + 1, F.col("blocks") - 1))).alias("block"))
    covered = F.least(F.col("end"), F.expr("(block + 1) * cell_words div blocks")) - F.greatest(F.col("start"), F.expr("block * cell_words div blocks"))
    p = picked.select(F.col("source").alias("__s"), F.col("shard").alias("__sh"), F.col("block").alias("__b"))
    hits = spans.withColumn("words", covered).where("words > 0").join(p, F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__sh")) & (F.col("block") == F.col("__b")))
    part = hits.groupBy("__row").agg(F.sum("words").alias("part"))
    done = placed.join(part, "__row", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    return done.select(
        F.col("__id").alias(id_col), F.col("source").alias(source_col), F.col("__text").alias("text_hash"), "size", "source_size", "target", "passes", "part",
        (F.col("passes") * F.col("size") + F.col("part")).alias("taken"),
    )


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, all columns as they are.

    A row is repeated once for each whole pass. The words of the partial pass become a
    whole further copy with the chance that is their share of the row's words, drawn by
    a hash of seed, id and text, so a source's words come near its target. Texts without
    words, of which the mix takes none, are left out.
    """
    mix = mix_sources(docs, weights, seed, id_col, text_col, source_col)
    # Rows that agree in id, source and text may differ in what is taken; they share it.
    keys = [F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col("text_hash").alias("__hash"), F.col("size").alias("__size")]
    mix = mix.groupBy(*keys).agg(F.avg("taken").alias("__taken")).where("__taken > 0")
    hashed = docs.withColumn("__text", F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__text") == F.col("__hash"))
    draw = F.pmod(seeded(seed + 3, F.col("__id"), F.col("__hash")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("__taken") / F.col("__size") + draw).cast("int")
    rows = hashed.join(mix, same).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return rows.drop("__id", "__source", "__hash", "__size", "__taken", "__text", "__copy")
