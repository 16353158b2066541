"""Operator 2, toxicity: Levenshtein automata over a lexicon trie, and context windows.

The lexicon (words, and stems that begin words) and the words known to be clean are
learnt from labelled rows. A text's words run through the product of the trie and a
Levenshtein automaton, which is made deterministic state by state as words need it, so a
word costs a lookup a letter until no term can match any more. Each match is weighed by
the window of words around it: quoted or reported it counts little, next to other
matches or aimed at the reader it counts more. A logistic curve, fitted to the labelled
rows, turns the sum into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, seeded, small, small_batches

#: Labelled rows that are learnt from at most.
SAMPLE_ROWS = 40_000
#: A term is taken if this likelihood ratio statistic and this share of toxic rows are reached.
LEAST_GAIN, LEAST_SHARE = 20.0, 0.9
STEM_LENGTHS = (4, 5, 6, 7)
#: A term is matched only as it is spelt if words within its edits are in so many clean rows, against its own share of toxic rows.
NEAR_SHARE = 0.1
#: Words on each side of a match that weigh it.
WINDOW = 8
#: Words, and automaton states, that a worker remembers.
REMEMBERED, STATES = 1 << 17, 1 << 14
#: Rows whose terms are put together before they are sent on; places of term hashes by which most other terms are passed over.
COUNTED_ROWS, PLACES = 256, 1 << 22
TOKEN = re.compile(r"[^\W_]+")

# Quotation marks, words that report speech, words that address the reader.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says say saying wrote writes called calls quote quoted quotes quoting term word words phrase insult insults slur slurs define defined definition sagte schrieb nannte wort dit appelle mot dijo llama palabra".split())
ADDRESSING = frozenset("you your youre u ur du dich dein ihr euch tu te toi ton vous votre usted tus ustedes".split())
QUOTED, REPORTED, AIMED, CROWD, MISSPELT = 0.35, 0.5, 1.25, 0.25, 0.6


def allowed_edits(term: str) -> int:
    """Edits that a misspelt term may have: a stem of under six letters or a word of under four has none."""
    if term.endswith("*"):
        return 0 if len(term) < 7 else 1
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class Automaton:
    """The trie of a lexicon, met with a Levenshtein automaton for each term.

    A state is the set of (trie node, edits) that the letters read so far can have come
    to, and the best stem met on the way. States and their moves are made when first
    needed and kept; a term "abc*" matches words that begin with abc.
    """

    def __init__(self, terms: list[str], exact: frozenset[str] = frozenset()):
        """exact: terms that are matched without edits."""
        self.terms = terms
        self.edits = [0 if t in exact else allowed_edits(t) for t in terms]
        self.child: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.most = [0]
        for i, term in enumerate(terms):
            at, edits = 0, self.edits[i]
            self.most[0] = max(self.most[0], edits)
            for ch in term.rstrip("*"):
                if ch not in self.child[at]:
                    self.child[at][ch] = len(self.child)
                    self.child.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.most.append(0)
                at = self.child[at][ch]
                self.most[at] = max(self.most[at], edits)
            (self.stem if term.endswith("*") else self.word)[at] = i
        self._forget()

    def _forget(self) -> None:
        self.ids: dict = {}
        self.sets: list = []
        self.moves: list[dict[str, int]] = []
        self.ends: list = []
        self.start = self._state({0: 0}, None)

    def _state(self, reached: dict[int, int], best: tuple[int, int] | None) -> int:
        """The state of (node: least edits), closed over letters that the text leaves out."""
        todo = list(reached.items())
        while todo:
            node, e = todo.pop()
            for nxt in self.child[node].values():
                if e + 1 <= self.most[nxt] and reached.get(nxt, 9) > e + 1:
                    reached[nxt] = e + 1
                    todo.append((nxt, e + 1))
        for node, e in reached.items():
            i = self.stem[node]
            if i >= 0 and e <= self.edits[i] and (best is None or (e, i) < best):
                best = (e, i)
        key = (frozenset(reached.items()), best)
        if key not in self.ids:
            end = best
            for node, e in reached.items():
                i = self.word[node]
                if i >= 0 and e <= self.edits[i] and (end is None or (e, i) < end):
                    end = (e, i)
            self.ids[key] = len(self.sets)
            self.sets.append((reached, best))
            self.moves.append({})
            self.ends.append(end)
        return self.ids[key]

    def _move(self, state: int, ch: str) -> int:
        reached, best = self.sets[state]
        out: dict[int, int] = {}
        for node, e in reached.items():
            for letter, nxt in self.child[node].items():
                cost = e + (letter != ch)
                if cost <= self.most[nxt] and out.get(nxt, 9) > cost:
                    out[nxt] = cost
            if e + 1 <= self.most[node] and out.get(node, 9) > e + 1:
                out[node] = e + 1
        self.moves[state][ch] = made = self._state(out, best)
        return made

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, the first of the lexicon on ties; None if none is near enough."""
        if len(self.sets) > STATES:
            self._forget()
        at = self.start
        for ch in word:
            nxt = self.moves[at].get(ch)
            at = self._move(at, ch) if nxt is None else nxt
            if not self.sets[at][0]:
                return self.sets[at][1]
        return self.ends[at]


@dataclass
class Model:
    """terms with weights, terms that allow no edits, words that are no misspellings, and the curve
    score = 1 / (1 + exp(-(bias + slope * sum)))."""

    terms: list[str]
    weights: list[float]
    exact: frozenset[str] = frozenset()
    clean: frozenset[str] = frozenset()
    bias: float = -3.0
    slope: float = 2.0
    _automaton: Automaton | None = field(default=None, repr=False)
    _known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None, "_known": {}}

    def hit(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of a word that is a term or a misspelt one."""
        if word in self._known:
            return self._known[word]
        if self._automaton is None:
            self._automaton = Automaton(self.terms, self.exact)
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        found = self._automaton.match(word)
        if found is not None and found[0] and word in self.clean:
            found = None
        out = None if found is None else (self.weights[found[1]] * MISSPELT ** found[0], found[0])
        self._known[word] = out
        return out

    def matches(self, text: str | None) -> list[tuple[int, int, str, int, float]]:
        """(start, end, word, edits, weight in context) of each match in a text."""
        low = (text or "").lower()
        words = TOKEN.findall(low)
        marked = {w for w in set(words) if self.hit(w)}
        if not marked:
            return []
        places = [(m.start(), m.end()) for m in TOKEN.finditer(low)]
        at = [i for i, w in enumerate(words) if w in marked]
        out, seen, upto = [], 0, 0
        for n, i in enumerate(at):
            weight, edits = self.hit(words[i])
            lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
            around = words[lo:i] + words[i + 1 : hi]
            # an odd number of marks between the window's first word and the match, and one after it
            before = sum(low.count(q, places[lo][0] - (lo > 0), places[i][0]) for q in QUOTES)
            after = sum(low.count(q, places[i][1], places[hi - 1][1] + 1) for q in QUOTES)
            if before % 2 == 1 and after:
                weight *= QUOTED
            if any(w in REPORTING for w in around):
                weight *= REPORTED
            if any(w in ADDRESSING for w in around):
                weight *= AIMED
            while at[seen] < lo:
                seen += 1
            while upto < len(at) and at[upto] < hi:
                upto += 1
            weight *= 1 + CROWD * min(4, upto - seen - 1)
            out.append((places[i][0], places[i][1], words[i], edits, weight))
        return out

    def total(self, text: str | None) -> float:
        """The sum over a text's matches, those beyond a few counting less and less."""
        return math.log1p(sum(m[4] for m in self.matches(text)))

    def score(self, total: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.bias + self.slope * total))))


def terms_of(text: str | None) -> tuple[set[str], int]:
    """The distinct words of a text and stems of its longer words, and the least word hash: a mark that copies share."""
    words = set(TOKEN.findall((text or "").lower()))
    out = set(words)
    for w in words:
        out.update(w[:n] + "*" for n in STEM_LENGTHS if len(w) > n)
    return out, min((crc32(w.encode()) * 0x9E3779B1 & 0xFFFFFFFF for w in words), default=0)


def _gain(pos: Column, neg: Column, all_pos: int, all_neg: int) -> Column:
    """Likelihood ratio statistic of a term's rows being toxic more often than rows are."""
    n, base = pos + neg, all_pos / (all_pos + all_neg)
    out = pos * F.log(pos / n / base) + F.when(neg > 0, neg * F.log(neg / n / (1 - base))).otherwise(0.0)
    return F.when(pos > n * base, 2 * out).otherwise(0.0)


def fit_curve(totals: list[float], labels: list[int]) -> tuple[float, float]:
    """Bias and slope of a logistic curve by Newton's method, with a small penalty on the slope so that
    rows that a threshold tells apart give a steep curve, not an endless one."""
    bias, slope = -3.0, 2.0
    if len(set(labels)) < 2:
        return bias, slope
    n, penalty = len(labels), 0.02
    for _ in range(60):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y in zip(totals, labels, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + slope * x))))
            w = p * (1 - p) + 1e-9
            g0 += p - y
            g1 += (p - y) * x
            h00 += w
            h01 += w * x
            h11 += w * x * x
        g1 += penalty * n * 0.001 * slope
        h11 += penalty * n * 0.001
        det = h00 * h11 - h01 * h01
        if det < 1e-9:
            break
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        size = max(1.0, abs(d0), abs(d1))
        bias, slope = bias - d0 / size, slope - d1 / size
        if abs(d0) + abs(d1) < 1e-6:
            break
    return bias, max(0.1, slope)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most sample_rows labelled rows, those of the least seeded hash, none of them held out.

    Terms are counted over those rows by distinct marks of their texts, so a group of
    copies counts as one text. Every term with enough toxic rows is held against the
    clean rows, on the executors. What reaches the driver is the terms that pass, the clean
    words near to them, a number a sampled row and PLACES numbers at most.
    """
    with small_batches(docs.sparkSession):
        return _learn(docs, labels, sample_rows, seed, id_col, text_col, label_col)


def _learn(docs: DataFrame, labels: DataFrame, sample_rows: int, seed: int, id_col: str, text_col: str, label_col: str) -> Model:
    usable = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    sample = usable.groupBy("__id").agg(F.max("label").alias("label")).orderBy(seeded(seed, F.col("__id")), "__id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("body")).join(F.broadcast(sample), "__id").select("body", "label")
    rows = materialize(rows.where("body is not null").distinct(), "labelled")

    def count(places: bytes | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), COUNTED_ROWS):
                    out: set[tuple[str, int]] = set()
                    for text in batch.column(0).slice(at, COUNTED_ROWS):
                        found, mark = terms_of(text.as_py())
                        out.update((t, mark) for t in found if places is None or places[crc32(t.encode()) % PLACES])
                    keys = list(out)
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())], names=["term", "mark"])

        return run

    def marks(label: int, places: bytes | None = None) -> DataFrame:
        return rows.where(F.col("label") == label).select("body").mapInArrow(count(places), "term string, mark long")

    n = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    all_pos, all_neg = n["p"], n["n"] - n["p"]
    if not all_pos or not all_neg:
        return Model([], [])
    # So many rows a term has to have, even without any that is clean.
    fewest = math.ceil(LEAST_GAIN / (2 * math.log((all_pos + all_neg) / all_pos)))
    often = marks(1).distinct().groupBy("term").agg(F.count("*").alias("p")).where(F.col("p") >= fewest)
    often = materialize(often, "often")
    places = bytearray(PLACES)
    for r in often.select((F.crc32(F.col("term").cast("binary")) % PLACES).alias("at")).distinct().collect():
        places[r["at"]] = 1
    # Terms that only share a place with one of those go here, before anything is moved.
    clean = marks(0, bytes(places)).join(small(often.select("term")), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("g"))
    counted = often.join(clean, "term", "left").select("term", "p", F.coalesce("g", F.lit(0)).alias("g"))
    passed = counted.where((F.col("p") >= LEAST_SHARE * (F.col("p") + F.col("g"))) & (_gain(F.col("p"), F.col("g"), all_pos, all_neg) >= LEAST_GAIN))
    good = {r["term"]: (r["p"], r["g"]) for r in passed.collect()}
    # A longer stem adds nothing to a shorter one that is as surely toxic; a word does, as it may be misspelt.
    share = {t: p / (p + g) for t, (p, g) in good.items()}
    kept = [t for t in good if not t.endswith("*") or not any(t.rstrip("*")[:k] + "*" in good and share[t.rstrip("*")[:k] + "*"] >= share[t] for k in STEM_LENGTHS if k < len(t.rstrip("*")))]
    kept.sort(key=lambda t: (-good[t][0], t))
    odds = lambda t: (good[t][0] + 0.5) / (all_pos + 1) * (all_neg + 1) / (good[t][1] + 0.5)
    weights = [max(0.2, min(1.5, math.log(odds(t)) / 6)) for t in kept]
    model = Model(kept, weights)

    automaton = Automaton(kept)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                matched = ((w, automaton.match(w)) for w in set(TOKEN.findall(text.as_py().lower())))
                found += [(w, kept[m[1]], label.as_py()) for w, m in matched if m and m[0]]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "term", "label"])

    # A misspelt term is in more toxic than clean rows, for its share of them; a word that is not is a word of its own.
    unsure = rows.mapInArrow(near, "word string, term string, label long").groupBy("word", "term").agg(F.sum("label").alias("p"), F.count_if(F.col("label") == 0).alias("g"))
    unsure = unsure.where("g > 0").withColumn("own", F.col("g") / all_neg >= F.col("p") / all_pos).collect()
    model.clean = frozenset(r["word"] for r in unsure if r["own"])
    crowd = Counter()
    for r in unsure:
        crowd[r["term"]] += r["g"]
    model.exact = frozenset(t for t, g in crowd.items() if g / all_neg > NEAR_SHARE * good[t][0] / all_pos)
    points = scored(rows.withColumn("k", F.monotonically_increasing_id()), model, "k", "body", ["label"]).select("total", "label").collect()
    model.bias, model.slope = fit_curve([r["total"] for r in points], [r["label"] for r in points])
    model._known.clear()
    return model


MATCH = "struct<start:int,end:int,word:string,edits:int,weight:double>"


def scored(docs: DataFrame, model: Model, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """id_col, keep columns, total, score and matches of each text."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    listed = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("word", pa.string()), ("edits", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.matches(t) for t in (x.as_py() for x in batch.column(1))]
            totals = [math.log1p(sum(m[4] for m in x)) for x in found]
            as_rows = pa.array([[dict(zip(("start", "end", "word", "edits", "weight"), m, strict=True)) for m in x] for x in found], listed)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(totals, pa.float64()), pa.array([model.score(t) for t in totals], pa.float64()), as_rows], names=["id", *[f"k{i}" for i in range(len(keep))], "total", "score", "matches"])

    out = rows.mapInArrow(run, f"id {kind}{more}, total double, score double, matches array<{MATCH}>")
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "total", "score", "matches")


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score (0 to 1), predicted (1 from 0.5 on), matches (start, end, word, edits, weight) of every text.

    Offsets are code points of the lower-cased text. Only rows that are not held out
    teach. Null and empty texts have no matches and the least score. Without labels of
    both kinds there is no lexicon and every text has the least score. Null ids count as
    held out; repeated rows are each scored; an empty table gives no rows; other columns
    are not read.
    """
    model = model or learn(docs, labels, id_col=id_col, text_col=text_col)
    with small_batches(docs.sparkSession):
        out = materialize(scored(docs.select(id_col, text_col), model, id_col, text_col, []), "scored")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matches")


def drop_toxic(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below the threshold; null and empty texts stay."""
    model = model or learn(docs, labels, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(model.total(t)) < threshold for t in (x.as_py() for x in batch.column(at))], pa.bool_()))

    with small_batches(docs.sparkSession):
        return materialize(docs.mapInArrow(run, docs.schema), "clean")
