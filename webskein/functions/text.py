"""Text functions as column expressions: cleaning, numbers, dates, titles, tags, fingerprints, classes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are no keywords; categories in the order that breaks ties; parts of placeholder covers.
STOP_WORDS = "the a an and or but in on with to for of at by is this that".split()
TAXONOMY = {
    "Anime": ["anime", "動畫", "番劇", "動漫", "劇場版", "OVA"],
    "Manga": ["manga", "漫畫", "同人誌", "單行本", "漫改"],
    "Game": ["game", "遊戲", "手遊", "單機", "攻略", "RPG", "ADV"],
    "Movie": ["movie", "電影", "影片", "視頻", "video", "4k", "1080p"],
    "Article": ["article", "文章", "資訊", "新聞", "科普", "教學"],
}
PLACEHOLDERS = "logo default placeholder avatar noimage no-image no_image siteicon site-icon site_icon missing".split()
MOST_TAGS, LEAST_TAG_LENGTH = 15, 2
# Patterns of numbers with a suffix and what it multiplies by, of dates, and of what parts a title from its site.
NUMBER = r"(\d{1,3}(?:[,\s]\d{3})+|\d+(?:\.\d+)?)\s*([kKmMbB千万亿]?)"
TIMES = {"": 1, "k": 10**3, "千": 10**3, "万": 10**4, "m": 10**6, "亿": 10**8, "b": 10**9}
DATES = (r"\b(\d{4})-(\d{1,2})-(\d{1,2})", r"\b(\d{4})/(\d{1,2})/(\d{1,2})\b", r"(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日?")
BARS, BAR_OR_DASH = r"\s*[|｜]\s*", r"\s*[|｜\-–—]\s*"
ZERO_SIMHASH = "0" * 16


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def metric_number(text: Column) -> Column:
    """The first number: grouped thousands, decimals, a suffix for thousands, millions or billions; null if there is none."""
    digits = F.regexp_replace(F.regexp_extract(text, NUMBER, 1), r"[,\s]", "")
    suffix = F.lower(F.regexp_extract(text, NUMBER, 2))
    times = F.element_at(F.create_map(*[F.lit(x) for pair in TIMES.items() for x in pair]), suffix).cast("double")
    return F.when(digits != "", F.floor(digits.try_cast("double") * times).cast("long"))


def date_of(text: Column) -> Column:
    """The first year-month-day of 1970 to 2099, by dashes, slashes or signs, padded; "" if there is none. Days run to 31 in every month."""
    found = []
    for rx in DATES:
        y, m, d = (F.regexp_extract(text, rx, i).try_cast("int") for i in (1, 2, 3))
        ok = y.between(1970, 2099) & m.between(1, 12) & d.between(1, 31)
        found.append(F.when(ok, F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))))
    return F.coalesce(*found, F.lit(""))


def strip_site(title: Column, chain: bool) -> Column:
    """The head of "Title | Site". chain: only if two bars or more part it, else at the first bar or dash."""
    if chain:
        parts = F.split(title, BARS)
        return F.when(F.size(parts) < 3, clean(title)).otherwise(clean(parts[0]))
    return clean(F.split(title, BAR_OR_DASH, 2)[0])


def srcset_best(srcset: Column) -> Column:
    """The widest candidate of a srcset (a density counts a thousand a unit), the first of equals or without any; "" for none."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda x: F.trim(x)), lambda x: x != "")
    width = lambda x: F.coalesce(F.regexp_extract(x, r"\s(\d+)w$", 1).try_cast("double"), F.regexp_extract(x, r"\s(\d+(?:\.\d+)?)x$", 1).try_cast("double") * 1000, F.lit(0.0))
    ranked = F.transform(parts, lambda x, i: F.struct(width(x).alias("w"), (-i).alias("i"), F.split(x, r"\s+")[0].alias("u")))
    return F.coalesce(F.array_max(ranked)["u"], F.lit(""))


def valid_cover(url: Column) -> Column:
    """Absolute or scheme-relative, and no part of a placeholder's name in the path."""
    from .urls import path

    p = F.lower(path(url))
    return F.coalesce((url.contains("://") | url.startswith("//")) & ~reduce(lambda a, b: a | b, [p.contains(s) for s in PLACEHOLDERS]), F.lit(False))


def split_keywords(text: Column) -> Column:
    parts = F.transform(F.split(text, "[,，、;；]+"), lambda x: F.trim(x))
    return F.coalesce(F.array_distinct(F.filter(parts, lambda x: x != "")), F.array().cast("array<string>"))


def curated(tags: Column) -> Column:
    """Whether a tag list looks chosen: some tags, not too many, not too short on average."""
    total = F.aggregate(tags, F.lit(0), lambda a, x: a + F.length(x))
    return F.coalesce((F.size(tags) > 0) & (F.size(tags) <= MOST_TAGS) & (total >= LEAST_TAG_LENGTH * F.size(tags)), F.lit(False))


def title_fingerprint(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, r"(?U)[^\w]+", ""))


def category(title: Column, tags: Column, taxonomy: dict[str, list[str]] = TAXONOMY) -> Column:
    """The category of most keyword hits, a title counting twice; the first declared of equals; Other without any."""
    text = F.concat(title, F.lit(" "), title, F.lit(" "), F.array_join(tags, " "))
    # Hits of one keyword do not overlap, those of different ones may.
    hits = {c: sum((F.regexp_count(text, F.lit(f"(?iu)\\Q{k}\\E")) for k in words), F.lit(0)) for c, words in taxonomy.items()}
    best = F.greatest(*hits.values())
    out = F.when(best == 0, "Other")
    for c, n in hits.items():
        out = out.when(n == best, c)
    return out


def keyword_frequency(rows: DataFrame, title: str = "title", k: int = 20) -> DataFrame:
    """Words of titles by number of uses: longer than two letters, no stop words, not all digits."""
    word = F.explode(F.regexp_extract_all(F.lower(title), F.lit(r"(?U)(\w+)"), F.lit(1)))
    kept = rows.select(word.alias("word")).where((F.length("word") > 2) & ~F.col("word").isin(STOP_WORDS) & ~F.col("word").rlike(r"^(?U)\d+$"))
    return kept.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints of 16 hex digits differ; 64 if one can't be read."""
    number = lambda x: F.when(x.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(x, 16, -10).cast("long"))
    return F.coalesce(F.bit_count(number(a).bitwiseXOR(number(b))), F.lit(64))


#: Hashes of words and pairs that a worker remembers.
_KNOWN: dict[str, bytes] = {}
REMEMBERED = 1 << 18


def _hashed(gram: str) -> bytes:
    """The first eight bytes of a SHA-256."""
    found = _KNOWN.get(gram)
    if found is None:
        if len(_KNOWN) >= REMEMBERED:
            _KNOWN.clear()
        found = _KNOWN[gram] = sha256(gram.encode()).digest()[:8]
    return found


def simhash_of(text: str | None) -> str:
    """16 hex digits: words and pairs of words, as often as they occur, vote with the bits of the first eight bytes of their SHA-256."""
    words = (text or "").lower().split()
    if not words:
        return ZERO_SIMHASH
    grams = Counter([*words, *map(" ".join, zip(words, words[1:]))])
    bits = np.unpackbits(np.frombuffer(b"".join(map(_hashed, grams)), dtype=np.uint8).reshape(-1, 8), axis=1)
    count = np.fromiter(grams.values(), dtype=np.int64, count=len(grams))
    votes = 2 * (count @ bits) - count.sum()
    return np.packbits(votes > 0).tobytes().hex()


def simhash(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and simhash of each row; blank texts have 16 zeros. A row's votes are counted where the row is: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([simhash_of(t.as_py()) for t in batch.column(1)], pa.string())], names=[key, "simhash"])

    return rows.select(key, text).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, simhash string")
