"""Operator 8, secret scans through a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: what every match must
hold. Postings (trigram, text) of the trigrams that occur in queries are intersected,
and only the texts left for a rule are searched with its regex. A rule without mandatory
trigrams, such as runs of hex digits, searches all texts. All of it is made of built-in
functions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

try:
    from re import _constants as sre, _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

#: Candidate keys up to this many are broadcast (16 MB); beyond it the texts are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: A set of strings larger than this is not followed further when a query is derived.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """kind names its spans; group of the match has to have least characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The base kinds, in the order in which spans of one start are listed.
BASE_RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Published token formats.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

#: All of the segments must hold; a segment holds if all trigrams of one of its alternatives occur.
Query = list[list[frozenset[str]]]


def trigram_query(regex: str) -> Query:
    """What the lower-cased text of every match holds. An empty query: no trigram is mandatory."""
    segments: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        least = [s for s in sets if not any(t < s for t in sets)]
        if least and frozenset() not in least:
            segments.append(sorted(least, key=sorted))

    def exact(node) -> set[str] | None:
        """All lower-cased strings that the node matches, None if there are too many."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            chars: set[str] = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= 8 else None
        if op is sre.SUBPATTERN:
            return sequence(arg[3])
        if op is sre.BRANCH:
            parts = [sequence(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            lo, hi, body = arg
            one = sequence(body)
            if one is None or hi is sre.MAXREPEAT or hi > 4:
                return None
            out: set[str] = set()
            for n in range(lo, hi + 1):
                out |= {"".join(p) for p in product(one, repeat=n)}
            return out if len(out) <= MOST_STRINGS else None
        return None

    def sequence(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            found = exact(node)
            if found is None:
                return None
            out = {a + b for a in out for b in found}
            if len(out) > MOST_STRINGS:
                return None
        return out

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            found = exact(node)
            joined = None if found is None else {a + b for a in run for b in found}
            if joined is not None and len(joined) <= MOST_STRINGS:
                run = joined
                continue
            flush(run)
            run = found or {""}
            if found is None and node[0] is sre.SUBPATTERN:
                walk(node[1][3])
            elif found is None and node[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT) and node[1][0] > 0:
                walk(node[1][2])
        flush(run)

    walk(list(sre_parse.parse(regex)))
    return segments


def postings(texts: DataFrame, trigrams: list[str], key: str = "key", body: str = "body") -> DataFrame:
    """The inverted index: (trigram, key), one row for each of the given trigrams that a lower-cased text holds."""
    low = texts.select(key, F.lower(body).alias("__low"))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("__low"), t))
    return low.select(key, F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[int, Query], key: str = "key") -> DataFrame:
    """(key, rules array<int>): the postings intersected for each rule; rules with an empty query are not listed."""
    spark = index.sparkSession
    terms = [(r, s, a, t, len(alt)) for r, q in queries.items() for s, seg in enumerate(q) for a, alt in enumerate(seg) for t in alt]
    needs = [(r, len(q)) for r, q in queries.items() if q]
    clauses = spark.createDataFrame(terms, "rule int, segment int, alternative int, trigram string, need int")
    whole = spark.createDataFrame(needs, "rule int, segments int")
    met = index.join(F.broadcast(clauses), "trigram").groupBy(key, "rule", "segment", "alternative", "need").agg(F.count("*").alias("n")).where("n = need")
    held = met.groupBy(key, "rule").agg(F.countDistinct("segment").alias("n")).join(F.broadcast(whole), "rule").where("n = segments")
    return held.groupBy(key).agg(F.sort_array(F.collect_set("rule")).alias("rules"))


SPAN = "array<struct<start:long,place:int,end:long,kind:string,from:long,until:long>>"
#: Numbers that are added up one after the other; longer lists are added up piece by piece.
PIECE = 256


def _let(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(numbers: Column, op) -> Column:
    """What op makes of each number and all before it, for an array of longs; op(a, b) is associative and op(0, b) is b.

    An array grows by being copied, so each piece of PIECE numbers is worked through by
    itself, then the pieces' last results, and then all is put together.
    """
    def in_order(xs: Column) -> Column:
        grown = F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))
        return F.slice(grown, 2, F.size(xs))

    def whole(xs: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(PIECE)), lambda at: in_order(F.slice(xs, at, PIECE)))

        def together(ps: Column) -> Column:
            upto = in_order(F.transform(ps, lambda p: F.element_at(p, -1)))
            before = F.concat(F.array(F.lit(0).cast("long")), F.slice(upto, 1, F.size(ps) - 1))
            return F.flatten(F.zip_with(ps, before, lambda p, b: F.transform(p, lambda x: op(b, x))))

        return _let(pieces, together)

    return _let(numbers, lambda xs: F.when(F.size(xs) == 0, xs).when(F.size(xs) <= PIECE, in_order(xs)).otherwise(whole(xs)))


def spans(body: Column, rule: Rule, place: int) -> Column:
    """Leftmost matches that do not overlap, as structs of offsets: start and end in code points, from and until in
    bytes; ends are exclusive.

    The pieces between matches and the matches themselves are lists of strings; their
    lengths, added up, are the offsets. Time grows with the text and its matches.
    """
    rx = F.lit(rule.regex)

    def found(hits: Column) -> Column:
        gaps = F.split(body, rule.regex, -1)

        def ends(length) -> Column:
            return running(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: (length(g) + length(h)).cast("long")), lambda a, b: a + b)

        values = F.regexp_extract_all(body, rx, F.lit(rule.group))
        each = F.arrays_zip(ends(F.char_length).alias("end"), ends(F.octet_length).alias("until"), hits.alias("hit"), values.alias("value"))
        kept = F.filter(each, lambda x: F.char_length(x["value"]) >= rule.least)
        return F.transform(kept, lambda x: F.struct(
            (x["end"] - F.char_length(x["hit"])).alias("start"), F.lit(place).alias("place"), x["end"].alias("end"), F.lit(rule.kind).alias("kind"),
            (x["until"] - F.octet_length(x["hit"])).alias("from"), x["until"].alias("until"),
        ))

    return F.when(F.regexp_like(body, rx), _let(F.regexp_extract_all(body, rx, F.lit(0)), found)).otherwise(F.array().cast(SPAN))


def _found(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """__id, the kept columns as __k0 and so on, body (null texts empty), spans."""
    queries = {i: trigram_query(r.regex) for i, r in enumerate(rules)}
    texts = docs.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    texts = texts.withColumn("key", F.xxhash64("body"))
    indexed = {i: q for i, q in queries.items() if q}
    if indexed:
        trigrams = sorted({t for q in indexed.values() for seg in q for alt in seg for t in alt})
        found = materialize(candidates(postings(texts, trigrams), indexed), "candidates")
        texts = texts.join(small(found, BROADCAST_KEYS), "key", "left")
    each = []
    for i, rule in enumerate(rules):
        own = spans(F.col("body"), rule, i)
        each.append(F.when(F.array_contains("rules", i), own).otherwise(F.array().cast(SPAN)) if queries[i] else own)
    return texts.select("__id", *[f"__k{i}" for i in range(len(keep))], "body", F.sort_array(F.concat(*each)).alias("spans"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of every whole text: id_col, body, spans (start, place, end, kind, from, until), by start and then place.

    start and end are offsets in code points, from and until in bytes, ends exclusive; spans of one kind do not overlap, those of
    different kinds may. Null texts count as empty and have no spans, as empty texts;
    null ids are rows like others; repeated rows are each scanned; an empty table gives
    no rows. Other columns are not read. Texts that are equal share one key of the
    index; a key that two texts share by accident only adds candidates.
    """
    return _found(docs, rules, id_col, text_col, []).withColumnRenamed("__id", id_col)


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(body: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with the mark in place of each span; spans that overlap become one mark. found: sorted by start.

    What lies between the spans is cut out of the text's bytes, and the pieces are put together once.
    """
    raw = body.cast("binary")

    def parts(spans: Column) -> Column:
        upto = running(F.transform(spans, lambda s: s["until"]), lambda a, b: F.greatest(a, b))

        def pieces(ends: Column) -> Column:
            before = F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, 1, F.size(ends) - 1))
            gaps = F.zip_with(spans, before, lambda s, b: F.when(s["from"] >= b, F.substring(raw, (b + 1).cast("int"), (s["from"] - b).cast("int")).cast("string")))
            last = F.substring(raw, (F.element_at(ends, -1) + 1).cast("int"), F.octet_length(body)).cast("string")
            return F.array_join(F.concat(F.filter(gaps, lambda g: g.isNotNull()), F.array(last)), mark)

        return _let(upto, pieces)

    return F.when(F.size(found) > 0, _let(found, parts)).otherwise(body)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs with a mark in place of each secret, and the length in code points, if there is a column
    length_col, where the text changed; null texts stay null and other columns as they are. An empty table gives no rows."""
    found = _found(docs, rules, id_col, text_col, docs.columns)
    hit = F.size("spans") > 0
    old = {c: F.col(f"__k{i}") for i, c in enumerate(docs.columns)}
    found = found.withColumn("__text", F.when(hit, redact(F.col("body"), F.col("spans"))).otherwise(old[text_col]))
    new = {text_col: F.col("__text")}
    if length_col in docs.columns:
        new[length_col] = F.when(hit, F.char_length("__text")).otherwise(old[length_col]).cast(docs.schema[length_col].dataType)
    return found.select(*[new.get(c, old[c]).alias(c) for c in docs.columns])
