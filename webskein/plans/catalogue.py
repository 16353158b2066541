"""The registered queries of the analytics operators, and DuckDB SQL for the same answers.

Every query runs over whole tables. Times are literals, so answers do not move.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as page_functions
from ..functions import text, urls
from ..operators import export, frontier, monitor, scores, search, similar, tables, tags
from ..sources import extract, fetched, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-03-01 12:00:00"

#: Scored resources for the SQL side.
SCORED = views.SQL + f""", top AS (
    SELECT scan_job_id, max(views) AS v, max(likes) AS l, max(hearts) AS h FROM resources GROUP BY 1
), scored AS (
    SELECT r.*, round(
        CASE WHEN v > 0 THEN 0.4::DOUBLE * views / v * 100 ELSE 0 END + CASE WHEN l > 0 THEN 0.3::DOUBLE * likes / l * 100 ELSE 0 END
        + CASE WHEN h > 0 THEN 0.2::DOUBLE * hearts / h * 100 ELSE 0 END
        + 0.1::DOUBLE * (100 / (1 + ln(1 + greatest(datediff('day', published_at::DATE, DATE '{NOW[:10]}'), 0)))), 2) AS popularity_score
    FROM resources r JOIN top USING (scan_job_id)
)"""


def register(sql: str | None = None, prelude: str = "") -> Callable[[Query], Query]:
    """Add a query under its function's name; prelude: common table expressions that its SQL may use."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {prelude}\n{sql}" if prelude else sql
        return f

    return add


def _now():
    return F.lit(NOW).cast("timestamp")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.popularity(views.resources(spark, sf_dir), _now())


def _tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.counts(views.resource_tags(spark, sf_dir))


# Scores


@register("SELECT id, scan_job_id, popularity_score FROM scored", SCORED)
def popularity_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "scan_job_id", "popularity_score")


@register(f"SELECT id, round(100 / (1 + ln(1 + greatest(datediff('day', published_at::DATE, DATE '{NOW[:10]}'), 0))), 6) AS recency FROM resources", views.SQL)
def recency(spark, sf_dir):
    return views.resources(spark, sf_dir).select("id", F.round(scores.recency(F.col("published_at"), _now()), 6).alias("recency"))


@register("SELECT id, title, popularity_score FROM scored ORDER BY popularity_score DESC, id LIMIT 100", SCORED)
def top_resources(spark, sf_dir):
    return scores.top_by_score(_scored(spark, sf_dir), 100).select("id", "title", "popularity_score")


@register(
    """SELECT tag, rank, id, popularity_score FROM (
        SELECT name AS tag, row_number() OVER (PARTITION BY name ORDER BY popularity_score DESC, id)::INTEGER AS rank, id, popularity_score FROM resource_tags JOIN scored USING (id)
    ) WHERE rank <= 10""",
    SCORED,
)
def tag_top_resources(spark, sf_dir):
    return scores.top_per_tag(_scored(spark, sf_dir))


# Tags


@register("SELECT scan_job_id, name, resource_count FROM tags", views.SQL)
def tag_counts(spark, sf_dir):
    return _tag_counts(spark, sf_dir)


@register("SELECT scan_job_id, name, resource_count, row_number() OVER (PARTITION BY scan_job_id ORDER BY resource_count DESC, name)::INTEGER AS place FROM tags", views.SQL)
def tag_stats(spark, sf_dir):
    from pyspark.sql import Window

    by = Window.partitionBy("scan_job_id").orderBy(F.desc("resource_count"), "name")
    return _tag_counts(spark, sf_dir).withColumn("place", F.row_number().over(by))


@register("SELECT scan_job_id, count(DISTINCT name) AS total_tags, count(DISTINCT id) AS total_resources, round(count(*) / count(DISTINCT id), 1) AS avg_tags FROM resource_tags GROUP BY 1", views.SQL)
def tag_overview(spark, sf_dir):
    return tags.overview(views.resources(spark, sf_dir))


@register("SELECT id, string_agg(name, '|' ORDER BY name) AS tag_names FROM resource_tags GROUP BY 1", views.SQL)
def resources_with_tags(spark, sf_dir):
    return tables.with_tags(views.resources(spark, sf_dir).select("id"), views.resource_tags(spark, sf_dir))


@register("SELECT a.name AS tag_a, b.name AS tag_b, count(*) AS n FROM resource_tags a JOIN resource_tags b ON a.id = b.id AND a.name < b.name GROUP BY 1, 2", views.SQL)
def tag_cooccurrence(spark, sf_dir):
    return tags.cooccurrence(views.resources(spark, sf_dir), k=None)


_GRAVITY = """grav AS (
    SELECT name, count(DISTINCT scan_job_id) AS site_coverage, sum(resource_count)::BIGINT AS volume, sum(popularity_score::DECIMAL(20,2))::DOUBLE AS total, count(*) AS links
    FROM resource_tags JOIN scored USING (id, scan_job_id) JOIN tags USING (scan_job_id, name) GROUP BY 1 HAVING sum(resource_count) > 2 ORDER BY total DESC, name LIMIT 30
), gravity AS (
    SELECT name, site_coverage, volume, round(total / links, 2) AS avg_score, round(total, 1) AS score, round(total / volume, 2) AS gravity FROM grav
)"""


@register("SELECT * FROM gravity", SCORED + ", " + _GRAVITY)
def tag_gravity(spark, sf_dir):
    return tags.gravity(_scored(spark, sf_dir), _tag_counts(spark, sf_dir))


@register("SELECT * FROM gravity WHERE site_coverage <= 50 ORDER BY score DESC, name LIMIT 5", SCORED + ", " + _GRAVITY)
def tag_gaps(spark, sf_dir):
    return tags.gaps(tag_gravity(spark, sf_dir), competitors=50)


@register(
    """SELECT name, recent::BIGINT AS recent, baseline::BIGINT AS baseline, round(recent / (baseline + 1), 4) AS velocity FROM (
        SELECT name, sum(resource_count) FILTER (WHERE created_at > TIMESTAMP '2024-02-20 12:00:00' - INTERVAL 3 DAY) AS recent,
               coalesce(sum(resource_count) FILTER (WHERE created_at <= TIMESTAMP '2024-02-20 12:00:00' - INTERVAL 3 DAY), 0) AS baseline
        FROM tags JOIN scan_jobs ON scan_job_id = scan_jobs.id GROUP BY 1
    ) WHERE recent IS NOT NULL ORDER BY velocity DESC, recent DESC, name LIMIT 15""",
    views.SQL,
)
def tag_velocity(spark, sf_dir):
    return tags.velocity(_tag_counts(spark, sf_dir), views.scan_jobs(spark, sf_dir), F.lit("2024-02-20 12:00:00").cast("timestamp"))


@register("SELECT name, sum(resource_count)::BIGINT AS total FROM tags GROUP BY 1 ORDER BY total DESC, name LIMIT 30", views.SQL)
def tag_cloud(spark, sf_dir):
    return tags.cloud(_tag_counts(spark, sf_dir))


# Look-ups and joins


@register("SELECT id, title, scan_job_id, popularity_score FROM scored JOIN resource_tags USING (id, scan_job_id) WHERE name = 'Brand#1'", SCORED)
def resources_by_tag(spark, sf_dir):
    return _scored(spark, sf_dir).where(F.array_contains("tags", "Brand#1")).select("id", "title", "scan_job_id", "popularity_score")


_PAGE_URLS = r"""parts AS (
    SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS netloc,
           regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query FROM pages
), urls AS (
    SELECT *, scheme || '://' || netloc || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN query = '?' THEN '' ELSE query END AS normal,
           replace(netloc, 'www.', '') AS site FROM parts
)"""


@register("SELECT page_id, normal AS url, md5(normal) AS fingerprint FROM urls", _PAGE_URLS)
def url_normalize(spark, sf_dir):
    normal = urls.normalize(F.col("url"))
    return views.table(spark, sf_dir, "pages").select("page_id", normal.alias("url"), urls.fingerprint(normal).alias("fingerprint"))


@register(
    r"""SELECT page_id, site, regexp_replace(path, '/\d+', '/*', 'g') AS pattern,
               regexp_matches(lower(path), '/(?:cdn-cgi|login|signup|register|logout|rss|feed|search|history|membership|support|email-protection|track|stats)\b|[-/](?:blob|commits|branches|tags|merge_requests|pipelines|jobs)\b') AS noise,
               regexp_matches(lower(path), '\.(jpg|jpeg|png|gif|svg|webp|ico|css|js|woff|woff2|ttf|eot|pdf|zip|tar|gz|rar|7z|mp4|mp3|m4a|wav|mkv|avi|wmv|exe|dmg|iso|xml|rss|json|atom)$') AS skipped
        FROM urls""",
    _PAGE_URLS,
)
def url_filters(spark, sf_dir):
    u = F.col("url")
    return views.table(spark, sf_dir, "pages").select("page_id", urls.site(u).alias("site"), urls.pattern(u).alias("pattern"), urls.is_noise(u).alias("noise"), urls.has_skipped_suffix(u).alias("skipped"))


@register(
    r"""SELECT page_id, (50 + CASE WHEN regexp_matches(lower(path), '/(?:archives|v|p|post|item|product|video|article|detail)/\d+|/\d+\.html$|/v/|/p/') THEN 30 ELSE 0 END
               + greatest(0, (3 - page_id % 5) * 5) + CASE WHEN regexp_matches(lower(path), '\.html?$') THEN 10 ELSE 0 END)::BIGINT AS score FROM urls""",
    _PAGE_URLS,
)
def url_priority(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", urls.priority(F.col("url"), F.col("page_id") % 5).cast("long").alias("score"))


@register(
    """SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN 'https://example.com/' || p_partkey WHEN 1 THEN 'http://example.com/p/' || p_partkey WHEN 2 THEN 'https://example.com/' || p_partkey
               WHEN 3 THEN 'https://example.com/' || p_partkey WHEN 4 THEN 'https://EXAMPLE.COM/' || p_partkey END AS entry FROM part"""
)
def url_entry(spark, sf_dir):
    """What users type: five forms of URLs, and seven that are none, are of other schemes or go to private hosts."""
    forms = ("https://example.com/", "http://example.com/p/", "  example.com/", "//example.com/", "HTTPS://EXAMPLE.COM/", "ftp://example.com/", "javascript:alert", "mailto:a@b.c", "example .com/", "http://localhost/", "https://169.254.169.254/", "https://[::1]/")
    typed = F.concat(F.element_at(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 12 + 1).cast("int")), F.col("p_partkey").cast("string"))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), urls.entry_url(typed).alias("entry"))


@register(
    """SELECT c_custkey, CASE WHEN c_custkey % 8 < 3 THEN (a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254))
               ELSE c_custkey % 8 < 7 END AS private FROM (SELECT c_custkey, c_custkey % 256 AS a, (c_custkey * 7) % 256 AS b FROM customer)"""
)
def private_hosts(spark, sf_dir):
    """IPv4 literals of every first number, reserved names, IPv6 with and without brackets, and names that are not private."""
    k = F.col("c_custkey")
    number = F.concat_ws(".", k % 256, (k * 7) % 256, F.lit(9), F.lit(8))
    named = F.element_at(F.array(*map(F.lit, ("LocalHost", "[::1]", "fe80::1", "fd00::1", "2606:4700:4700::1111"))), (k % 8 - 2).cast("int"))
    return views.table(spark, sf_dir, "customer").select("c_custkey", urls.is_private_name(F.when(k % 8 < 3, number).otherwise(named)).alias("private"))


@register(
    r"""SELECT u.normal AS url, min(u.page_id % 5)::INTEGER AS depth, 50 + 5 * (3 - min(u.page_id % 5)::INTEGER) + CASE WHEN regexp_matches(lower(path), '/(?:archives|v|p|post|item|product|video|article|detail)/\d+|/\d+\.html$|/v/|/p/') THEN 30 ELSE 0 END
              + CASE WHEN regexp_matches(lower(path), '\.html?$') THEN 10 ELSE 0 END AS score
       FROM urls u WHERE u.page_id % 5 <= 3 AND md5(u.normal) NOT IN (SELECT md5(normal) FROM urls WHERE scheme = 'http')
         AND NOT regexp_matches(lower(path), '/(?:cdn-cgi|login|signup|register|logout|rss|feed|search|history|membership|support|email-protection|track|stats)\b|[-/](?:blob|commits|branches|tags|merge_requests|pipelines|jobs)\b')
         AND NOT regexp_matches(lower(path), '\.(jpg|jpeg|png|gif|svg|webp|ico|css|js|woff|woff2|ttf|eot|pdf|zip|tar|gz|rar|7z|mp4|mp3|m4a|wav|mkv|avi|wmv|exe|dmg|iso|xml|rss|json|atom)$')
       GROUP BY u.normal, path""",
    _PAGE_URLS,
)
def new_links_anti(spark, sf_dir):
    """Each page as a link from its own site, against those visited: the ones without encryption."""
    p = views.table(spark, sf_dir, "pages")
    links = p.select("url", (F.col("page_id") % 5).cast("int").alias("depth"))
    return frontier.new_links(links, p.where(urls.scheme(F.col("url")) == "http"), F.col("url"), max_depth=3, max_pages=10**6).select("url", "depth", "score")


# Page heuristics


@register(
    r"""SELECT page_id, html = '' OR contains(html, '__NEXT_DATA__') OR contains(html, 'data-reactroot') OR contains(html, '__nuxt') OR contains(html, 'document.getElementById(''root'')') OR contains(html, 'react-root')
               OR (length(trim(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<.*?>', '', 'g'), E' \t\n\r')) < 300 AND contains(lower(html), 'javascript') AND (contains(lower(html), 'enable') OR contains(lower(html), 'required')))
               OR length(html) < 1024 AS needs_js FROM pages"""
)
def needs_js(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", page_functions.needs_js(F.col("html")).alias("needs_js"))


@register("SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'no_indicator' WHEN 1 THEN 'spa_shell' WHEN 2 THEN 'spa_shell' WHEN 3 THEN 'static' ELSE 'no_indicator' END AS reason FROM part")
def should_render(spark, sf_dir):
    """Blank pages, module scripts, near-empty bodies, long pages with three of the telling metas and with two, and middling ones."""
    k = F.col("p_partkey") % 6
    metas = F.lit('<meta property="og:title" content="a"><meta name="description" content="b">')
    third = F.lit('<meta name="twitter:card" property="twitter:card" content="c">')
    words = lambda n: F.repeat(F.concat(F.col("p_name"), F.lit(" ")), n)
    html = (
        F.when(k == 0, "").when(k == 1, F.concat(F.lit("<html><script type='module' src=a></script><body>"), words(2000), F.lit("</body></html>")))
        .when(k == 2, F.concat(F.lit("<html><body><div>"), F.col("p_name"), F.lit("</div></body></html>")))
        .when(k == 3, F.concat(F.lit("<html>"), metas, third, F.lit("<body>"), words(4000), F.lit("</body></html>")))
        .when(k == 4, F.concat(F.lit("<html>"), metas, F.lit("<body>"), words(4000), F.lit("</body></html>")))
        .otherwise(F.concat(F.lit("<html>"), metas, third, F.lit("<body>"), words(200), F.lit("</body></html>")))
    )
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), page_functions.render_reason(html).alias("reason"))


@register(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'connection_timeout' WHEN 1 THEN 'read_timeout' WHEN 2 THEN 'ssl_error' WHEN 3 THEN 'dns_failed'
               WHEN 4 THEN CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'waf_blocked' ELSE 'forbidden' END ELSE 'http_500' END ELSE 'fetch_failed' END AS failure FROM events"""
)
def failure_class(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("connect_timeout", "read_timeout", "ssl", "connection", "http", "other")]), (F.col("event_id") % 6 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", 403).otherwise(500)
    body = F.when(F.col("event_id") % 4 == 0, "Blocked by Cloudflare").otherwise("no entry")
    return views.table(spark, sf_dir, "events").select("event_id", page_functions.failure_class(kind, status, body).alias("failure"))


# Text


@register(
    r"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+')) AS word FROM part)
       WHERE length(word) > 2 AND word NOT IN ('the','a','an','and','or','but','in','on','with','to','for','of','at','by','is','this','that') AND NOT regexp_matches(word, '^\d+$')
       GROUP BY 1 ORDER BY n DESC, word LIMIT 20"""
)
def keyword_frequency(spark, sf_dir):
    return text.keyword_frequency(views.resources(spark, sf_dir))


@register("SELECT id, CASE id % 8 WHEN 1 THEN 'Anime' WHEN 2 THEN 'Manga' WHEN 3 THEN 'Game' WHEN 4 THEN 'Movie' WHEN 5 THEN 'Article' WHEN 6 THEN 'Game' WHEN 7 THEN 'Movie' ELSE 'Other' END AS predicted FROM resources", views.SQL)
def classify(spark, sf_dir):
    """Titles with keywords of every category, one with a tie, which goes to the category declared first, and tags that outvote a title."""
    words = ("plain", "Anime OVA", "同人誌 MANGA", "rpg game movie", "movie video game", "新聞", "game movie", "game")
    title = F.concat_ws(" ", "title", F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 8 + 1).cast("int")))
    tagged = F.when(F.col("id") % 8 == 7, F.array(*map(F.lit, ("movie", "video 4k", "1080p")))).otherwise(F.array("category"))
    return views.resources(spark, sf_dir).select("id", text.category(title, tagged).alias("predicted"))


@register(
    """SELECT p_partkey AS id, list_aggregate(list_distinct(['x', lower(p_type), p_brand]), 'count')::INTEGER AS n, 'x' || '|' || lower(p_type) || '|' || p_brand AS tags,
              (length('x') + length(p_type) + length(p_brand)) / 3 >= 2 AS curated FROM part"""
)
def keyword_split(spark, sf_dir):
    got = text.split_keywords(F.concat(F.lit(" x, "), F.lower("p_type"), F.lit("；"), F.col("p_brand"), F.lit("、x")))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), got.alias("t")).select("id", F.size("t").alias("n"), F.array_join("t", "|").alias("tags"), text.curated(F.col("t")).alias("curated"))


@register(
    """SELECT l_orderkey, l_linenumber, (l_quantity * 1000)::BIGINT AS thousands, l_quantity::BIGINT AS plain, (l_quantity * 10000)::BIGINT AS wan FROM lineitem"""
)
def metric_numbers(spark, sf_dir):
    q = F.col("l_quantity").cast("long").cast("string")
    return views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", text.metric_number(F.concat(F.lit("views "), q, F.lit("K"))).alias("thousands"),
        text.metric_number(F.concat(q, F.lit(" likes"))).alias("plain"), text.metric_number(F.concat(q, F.lit("万"))).alias("wan"),
    )


@register("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS cjk FROM orders")
def date_normalize(spark, sf_dir):
    d = F.col("o_orderdate")
    cjk = F.concat(F.year(d), F.lit("年"), F.month(d), F.lit("月 "), F.dayofmonth(d), F.lit("日"))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", text.date_of(F.concat(F.lit("on "), F.date_format(d, "yyyy/M/d"))).alias("iso"), text.date_of(cjk).alias("cjk"))


@register("SELECT p_partkey AS id, p_name AS chain, p_name AS head, lower(replace(p_name, ' ', '')) AS fingerprint FROM part")
def title_clean(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    chain = F.concat(F.lit("  "), F.col("p_name"), F.lit(" ｜ "), F.col("p_type"), F.lit("|Shop"))
    return p.select(F.col("p_partkey").alias("id"), text.strip_site(chain, True).alias("chain"), text.strip_site(F.concat("p_name", F.lit(" - Shop")), False).alias("head"), text.title_fingerprint(F.col("p_name")).alias("fingerprint"))


@register(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'https://c.example/logo/' || p_partkey || '-2x.jpg' ELSE 'https://c.example/' || p_partkey || '-' || greatest(p_size, 25) || '.jpg' END AS cover,
              p_partkey % 3 <> 0 AS ok, p_partkey % 2 = 0 AS absolute FROM part"""
)
def cover_urls(spark, sf_dir):
    """The widest of two candidates, or the densest, and whether covers pass: not a logo, not relative."""
    one = lambda w: F.concat(F.lit("https://c.example/"), F.col("p_partkey"), F.lit("-"), w, F.lit(".jpg "), w, F.lit("w"))
    wide = F.concat(one(F.lit(25)), F.lit(", "), one(F.col("p_size")))
    dense = F.concat(F.lit("https://c.example/logo/"), "p_partkey", F.lit("-1x.jpg 1x, https://c.example/logo/"), "p_partkey", F.lit("-2x.jpg 2x"))
    best = text.srcset_best(F.when(F.col("p_partkey") % 3 == 0, dense).otherwise(wide))
    other = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("//c.example/"), "p_partkey")).otherwise(F.concat(F.lit("/c/"), "p_partkey"))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), best.alias("cover"), text.valid_cover(best).alias("ok"), text.valid_cover(other).alias("absolute"))


_SIMHASH = """words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents
), grams AS (
    SELECT doc_id, unnest(w) AS g FROM words UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words)
), hashes AS (
    SELECT doc_id, ('0x' || substr(sha256(g), 1, 16))::UBIGINT AS h FROM grams
), bits AS (
    SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM hashes, (SELECT unnest(range(64)) AS i) GROUP BY 1, 2
), prints AS (
    SELECT doc_id, lpad(lower(to_hex(coalesce(sum(CASE WHEN v > 0 THEN (1::UBIGINT << i::UBIGINT) ELSE 0::UBIGINT END), 0)::UBIGINT)), 16, '0') AS simhash FROM documents LEFT JOIN bits USING (doc_id) GROUP BY 1
)"""


@register("SELECT doc_id, simhash FROM prints", _SIMHASH)
def simhash(spark, sf_dir):
    return text.simhash(views.table(spark, sf_dir, "documents"), "doc_id", "text")


def _items(docs):
    made = text.simhash(docs, "doc_id", "text")
    lang = docs.select("doc_id", "lang", "n_chars", F.substring("text", 1, 40).alias("title"), "source")
    return made.join(lang, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("scan_job_id"), "simhash", F.col("n_chars").cast("double").alias("popularity_score"), "title", F.array("source", "lang").alias("tags"))


@register(
    """SELECT p.doc_id AS id, bit_count(xor(('0x' || p.simhash)::UBIGINT, ('0x' || t.simhash)::UBIGINT)::BIT)::INTEGER AS distance, n_chars::DOUBLE AS popularity_score
       FROM prints p JOIN documents d USING (doc_id), (SELECT lang, simhash, doc_id AS tid FROM prints JOIN documents USING (doc_id) WHERE doc_id = (SELECT min(doc_id) FROM documents)) t
       WHERE d.lang = t.lang AND p.doc_id <> t.tid AND bit_count(xor(('0x' || p.simhash)::UBIGINT, ('0x' || t.simhash)::UBIGINT)::BIT) <= 15 ORDER BY distance, popularity_score DESC, id LIMIT 5""",
    _SIMHASH,
)
def similar_items(spark, sf_dir):
    """Only documents of the target's scan are hashed."""
    docs = views.table(spark, sf_dir, "documents")
    first = docs.agg(F.min_by("lang", "doc_id").alias("lang"), F.min("doc_id").alias("first"))
    items = _items(docs.join(F.broadcast(first.select("lang")), "lang"))
    return similar.similar_items(items, items.join(F.broadcast(first.select(F.col("first").alias("id"))), "id"))


#: Items in order, one a round, each led by the first leader near enough, or leading.
_CLUSTERS = _SIMHASH + """, ranked AS (
    SELECT lang AS job, doc_id AS id, ('0x' || simhash)::UBIGINT AS h, simhash = '0000000000000000' AS zero, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM prints JOIN documents USING (doc_id)
), led(job, r, id, leader, heads) AS (
    SELECT job, r, id, id, [{'id': id, 'h': h}] FROM ranked WHERE r = 1
    UNION ALL
    SELECT job, r, id, coalesce(near, id), CASE WHEN near IS NULL THEN list_append(heads, {'id': id, 'h': h}) ELSE heads END FROM (
        SELECT i.*, led.heads, CASE WHEN NOT i.zero THEN list_filter(led.heads, lambda x: bit_count(xor(x.h, i.h)::BIT) <= 15)[1].id END AS near FROM led JOIN ranked i ON i.job IS NOT DISTINCT FROM led.job AND i.r = led.r + 1
    )
)"""


@register("SELECT job AS scan_job_id, id, leader FROM led", _CLUSTERS)
def clusters(spark, sf_dir):
    return similar.leader_clusters(_items(views.table(spark, sf_dir, "documents")))


@register(
    """SELECT leader, size, title, coalesce(common_tags, '') AS common_tags, avg_score FROM (
        SELECT leader, count(*) AS size, substr(first(text ORDER BY n_chars DESC, id), 1, 40) AS title, round(avg(n_chars), 1) AS avg_score FROM led JOIN documents ON doc_id = id GROUP BY 1 HAVING count(*) > 1
    ) LEFT JOIN (
        SELECT leader, string_agg(tag, ', ' ORDER BY tag) AS common_tags FROM (
            SELECT leader, tag, count(*) AS n FROM (SELECT leader, unnest(list_distinct([source, lang])) AS tag FROM led JOIN documents ON doc_id = id) GROUP BY 1, 2
        ) JOIN (SELECT leader, count(*) AS m FROM led GROUP BY 1) USING (leader) WHERE n = m GROUP BY 1
    ) USING (leader)""",
    _CLUSTERS,
)
def cluster_report(spark, sf_dir):
    items = _items(views.table(spark, sf_dir, "documents"))
    return similar.cluster_report(items, similar.leader_clusters(items))


@register("SELECT p_partkey AS id FROM part WHERE regexp_matches(lower(p_name), '\\bsmall ri')")
def search_phrase(spark, sf_dir):
    return search.search(views.resources(spark, sf_dir), "small ri*", k=None).select("id")


@register(
    r"""WITH t AS (
        SELECT p_partkey AS id, regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+') AS a, regexp_extract_all(lower(p_type), '[\p{L}\p{N}_]+') AS b FROM part
    ), h AS (
        SELECT id, a, len(a) + len(b) AS len, list_filter(range(1, len(a)), lambda i: a[i] = 'small' AND starts_with(a[i + 1], 'ring')) AS ha, list_filter(range(1, len(b)), lambda i: b[i] = 'small' AND starts_with(b[i + 1], 'ring')) AS hb FROM t
    ), f AS (
        SELECT *, len(ha) + len(hb) AS tf FROM h
    ), s AS (
        SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (WHERE tf > 0) AS df FROM f
    )
    SELECT id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS rank_score,
           array_to_string(list_transform(a, lambda w, i: CASE WHEN i = ha[1] OR i = ha[1] + 1 THEN '<b>' || w || '</b>' ELSE w END), ' ') AS snippet
    FROM f, s WHERE tf > 0 ORDER BY rank_score DESC, id LIMIT 50"""
)
def search_ranked(spark, sf_dir):
    return search.search(views.resources(spark, sf_dir), "small ring")


# Extraction: pages are made from columns, so the columns are the answer.


def _synthetic(spark, sf_dir):
    meta = lambda k, v: F.concat(F.lit(f'<meta property="{k}" content="'), v, F.lit('">'))
    html = F.concat(
        F.lit("<html><head><title>x - Site</title>"), meta("og:title", F.col("title")), meta("og:image", F.concat(F.lit("https://c.example/"), F.col("id"), F.lit(".jpg"))), meta("article:section", F.col("category")),
        meta("article:published_time", F.col("published_at")), F.lit('<script type="application/ld+json">{"@type":"VideoObject","interactionStatistic":[{"interactionType":{"@type":"WatchAction"},"userInteractionCount":'),
        F.col("views"), F.lit('}]}</script></head><body><article><h1>Other</h1><p>likes '), F.col("likes"), F.lit("<p>hearts "), F.col("hearts"),
        F.lit('<p><a href="/tag/a/">'), F.col("category"), F.lit('</a><a rel="tag" href="/x">b&amp;c</a><a href="#top">top</a><a href="mailto:a@b.c">m</a></article></body></html>'),
    )
    return views.resources(spark, sf_dir).select(F.col("id").alias("page_id"), F.concat(F.lit("https://shop.example/item/"), "id").alias("url"), html.alias("html"))


@register("SELECT id AS page_id, 'detail' AS page_type, title, 'https://c.example/' || id || '.jpg' AS cover_url, views, likes, hearts, category, published_at, category || '|b&c' AS tags, 'opengraph' AS title_from, 'jsonld' AS views_from, CASE WHEN likes > 0 THEN 'dom' ELSE 'missing' END AS likes_from FROM resources", views.SQL)
def extract_detail(spark, sf_dir):
    r = extract.resources(extract.parsed(_synthetic(spark, sf_dir)))
    return r.select("page_id", "page_type", "title", "cover_url", "views", "likes", "hearts", "category", "published_at", F.array_join("tags", "|").alias("tags"), F.col("provenance")["title"].alias("title_from"), F.col("provenance")["views"].alias("views_from"), F.col("provenance")["likes"].alias("likes_from"))


@register("SELECT id AS page_id, 'https://shop.example/tag/a/,https://shop.example/x' AS links FROM resources", views.SQL)
def extract_links(spark, sf_dir):
    """Rules of resources do not run."""
    return extract.parsed(_synthetic(spark, sf_dir), parts=("links",)).select("page_id", F.array_join("links", ",").alias("links"))


@register(
    """SELECT p_size::BIGINT AS page_id, 'tag' AS page_type, p_name AS title, 'https://shop.example/part/' || p_partkey AS url, 'https://shop.example/c/' || p_partkey || '.png' AS cover_url FROM part WHERE p_size IN (SELECT p_size FROM part GROUP BY 1 HAVING count(*) > 1)"""
)
def extract_list(spark, sf_dir):
    """A page a scan with a card for each of its resources."""
    card = F.concat(F.lit('<div class="card"><a href="/part/'), "p_partkey", F.lit('"><img src="/c/'), "p_partkey", F.lit('.png"></a><h3>'), "p_name", F.lit("</h3></div>"))
    pages = views.table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("page_id")).agg(F.concat(F.lit("<html><body>"), F.array_join(F.collect_list(card), ""), F.lit("</body></html>")).alias("html"))
    return extract.resources(extract.parsed(pages.withColumn("url", F.lit("https://shop.example/tag/all/")))).select("page_id", "page_type", "title", "url", "cover_url")


@register(
    """SELECT page_id, len(regexp_extract_all(html, '<a ')) AS anchors, trim(replace(regexp_extract(html, '<h1[^>]*>([^<]*)', 1), '&amp;', '&')) AS title FROM pages"""
)
def page_resources(spark, sf_dir):
    r = extract.resources(extract.parsed(views.table(spark, sf_dir, "pages"), "modular"))
    return r.select("page_id", F.regexp_extract("content_dna", "_L(\\d+)_", 1).cast("long").alias("anchors"), F.trim("title").alias("title"))


@register(
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '/tags?/') THEN 'tag' WHEN trim(path, '/') = '' THEN 'other' ELSE 'detail' END AS page_type,
              len(list_distinct(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)))::INTEGER AS n_links,
              CASE WHEN NOT regexp_matches(url, '/tags?/') AND trim(path, '/') <> '' THEN 1 ELSE 0 END AS n_resources
       FROM urls JOIN (SELECT page_id, html FROM pages) USING (page_id)""",
    _PAGE_URLS,
)
def page_types(spark, sf_dir):
    """Each of these pages has an article and a headline, and no cards."""
    return extract.parsed(views.table(spark, sf_dir, "pages")).select("page_id", "page_type", F.size("links").alias("n_links"), F.size("resources").alias("n_resources"))


#: Made pages that one task parses; left to their bytes, some 100,000 of them would share a task.
PAGES_PER_TASK = 4_000


def _made(spark, sf_dir, *parts, url="https://shop.example/shop/item/"):
    """A page a resource, put together from strings and columns; {name} stands for a column. Pages are dealt out by id."""
    import re

    pieces = [F.col(x[1:-1]).cast("string") if x.startswith("{") else F.lit(x) for part in parts for x in re.split(r"(\{\w+\})", part) if x]
    dealt = views.resources(spark, sf_dir).repartition(-(-views.table(spark, sf_dir, "part").count() // PAGES_PER_TASK) or 1, "id")
    return dealt.select(F.col("id").alias("page_id"), F.concat(F.lit(url), "id").alias("url"), F.concat(*pieces).alias("html"))


_SOURCED = """SELECT id AS page_id, title, 'https://c.example/' || id || '.jpg' AS cover_url, category, published_at, '{0}' AS title_from, '{0}' AS cover_from FROM resources"""


def _sourced(pages, engine="rich"):
    r = extract.resources(extract.parsed(pages, engine))
    return r.select("page_id", "title", "cover_url", "category", "published_at", F.col("provenance")["title"].alias("title_from"), F.col("provenance")["cover_url"].alias("cover_from"))


@register(_SOURCED.format("jsonld"), views.SQL)
def extract_jsonld(spark, sf_dir):
    """An article's fields, its image an object, before OpenGraph; the site's name goes after two bars."""
    ld = '<script type="application/ld+json">{"@graph": [{"@type": "WebSite", "name": "no"}, {"@type": ["Thing", "Article"], "headline": "{title} | a | b", "image": {"url": "https://c.example/{id}.jpg"}, "articleSection": ["", "{category}"], "datePublished": "{published_at}"}]}</script>'
    return _sourced(_made(spark, sf_dir, '<html><head><meta property="og:title" content="no"><meta property="og:image" content="https://c.example/no.jpg">', ld, "</head><body><article><h1>no</h1></article></body></html>"))


@register("SELECT id AS page_id, title, 'https://c.example/' || id || '.jpg' AS cover_url, 'shop' AS category, published_at, 'twitter' AS title_from, 'twitter' AS cover_from FROM resources", views.SQL)
def extract_twitter(spark, sf_dir):
    """Cards fill in what neither JSON-LD nor OpenGraph has; a placeholder of OpenGraph is no cover; the category is the path's head, the date the page's."""
    head = '<meta name="twitter:title" content="{title}"><meta property="og:image" content="https://c.example/site-logo.png"><meta name="twitter:image:src" content="https://c.example/{id}.jpg">'
    return _sourced(_made(spark, sf_dir, "<html><head>", head, '</head><body><article><h1>no</h1><p>on <time datetime="{published_at}T10:00:00Z">then</time></article></body></html>'))


@register(_SOURCED.format("microdata"), views.SQL)
def extract_microdata(spark, sf_dir):
    """The longest outermost item; what a nested item says is its own."""
    body = (
        '<div itemscope itemtype="https://schema.org/Thing"><span itemprop="name">x</span></div><article itemscope itemtype="https://schema.org/Article"><div itemprop="author" itemscope itemtype="https://schema.org/Person"><span itemprop="name">somebody</span></div>'
        '<h1 itemprop="headline">{title}</h1><img itemprop="image" src="https://c.example/{id}.jpg"><a itemprop="articleSection" href="{category}">c</a><time itemprop="datePublished" datetime="{published_at}">d</time><p>some text that makes this item the longest of the page</p></article>'
    )
    return _sourced(_made(spark, sf_dir, "<html><body>", body, "</body></html>"))


@register(
    """SELECT id AS page_id, title, 'https://shop.example/big/' || id || '.jpg' AS cover_url, category, published_at, 'dom' AS title_from, 'dom' AS cover_from FROM resources""",
    views.SQL,
)
def extract_dom(spark, sf_dir):
    """Without any metadata: the title without its site, the largest image (lazy, no icon, not small), the breadcrumb's last other page, a date in the text.
    An element for a time, though it says none to machines, makes this a detail page; there is no headline."""
    body = (
        '<nav class="breadcrumb"><a href="/">home</a><a href="/c">{category}</a><a href="/shop/item/{id}">here</a></nav><article>short</article><main><article><img src="/small/{id}.jpg" width="40" height="40"><img src="/logo.png" width="900" height="900">'
        '<img data-src="/big/{id}.jpg" src="data:x" width="800" height="600"><img srcset="/mid/{id}.jpg 300w" width="300" height="200"><p><time>{published_at}</time> is when this was written, and this is a long article</p></article></main>'
    )
    return _sourced(_made(spark, sf_dir, "<html><head><title>{title} - Shop</title></head><body>", body, "</body></html>"))


@register("SELECT id AS page_id, likes, views, hearts FROM resources", views.SQL)
def extract_metrics(spark, sf_dir):
    """Numbers after a keyword, before one, and in a later sibling; a year by a copyright sign is none."""
    body = "<article><h1>x</h1><p>© 2024 views {views}</p><p>{likes} likes</p><div><b>收藏</b><i>of all</i><span>{hearts}</span></div></article>"
    return extract.resources(extract.parsed(_made(spark, sf_dir, "<html><body>", body, "</body></html>"))).select("page_id", "likes", "views", "hearts")


@register(
    """SELECT id AS page_id, title, 'https://c.example/' || id || '.jpg' AS cover_url, views, category, 't' || category || '|x' AS tags, 'jsonld' AS title_from, 'opengraph' AS cover_from FROM resources""",
    views.SQL,
)
def extract_modular(spark, sf_dir):
    """The modular engine: the last JSON-LD item's title holds, OpenGraph fills in, tags by links of any place."""
    ld = '<script type="application/ld+json">[{"headline": "no"}, {"@type": "VideoObject", "name": "{title}", "interactionStatistic": [{"interactionType": "http://schema.org/WatchAction", "userInteractionCount": "{views}"}]}]</script><script type="application/ld+json">broken</script>'
    head = '<html><head><meta property="og:image" content="https://c.example/{id}.jpg"><meta property="og:title" content="no">'
    body = '</head><body><a href="/category/a">{category}</a><a href="/tag/a">t{category}</a><a rel="tag" href="/b">x</a><a href="/c">y</a></body></html>'
    r = extract.resources(extract.parsed(_made(spark, sf_dir, head, ld, body), "modular"))
    return r.select("page_id", "title", "cover_url", "views", "category", F.array_join("tags", "|").alias("tags"), F.col("provenance")["title"].alias("title_from"), F.col("provenance")["cover_url"].alias("cover_from"))


# Persistence


@register("SELECT url, title FROM (SELECT 'https://shop.example/part/' || p_partkey AS url, p_name AS title, p_size FROM part) WHERE p_size > 25")
def insert_if_absent(spark, sf_dir):
    r = views.resources(spark, sf_dir)
    batch = r.select("url", "title", F.col("id").alias("seq")).unionByName(r.select("url", F.lit("again").alias("title"), (F.col("id") + 10**9).alias("seq")))
    return tables.insert_if_absent(r.where("scan_job_id <= 25").select("url"), batch, ["url"], "seq").select("url", "title")


_VAULT = """SELECT 'https://shop.example/' || title AS url, max_by(title, id) AS title, max_by(category, id) AS category, max(popularity_score) AS popularity_score,
       min_by(published_at, id) AS first_seen_at, max_by(published_at, id) AS last_updated_at FROM scored GROUP BY 1"""


@register(_VAULT, SCORED)
def vault_upsert(spark, sf_dir):
    """Resources by title, half of them merged into a vault that has the other half."""
    s = _scored(spark, sf_dir).select(F.concat(F.lit("https://shop.example/"), "title").alias("url"), "title", F.lit("").alias("cover_url"), "category", F.array_join("tags", ", ").alias("tags"), F.lit("").alias("content_fingerprint"), "popularity_score", F.col("published_at").alias("seen_at"), F.col("id").alias("seq"))
    half = s.agg(F.expr("max(seq) div 2")).first()[0] or 0
    vault = tables.vault_merge(None, s.where(F.col("seq") <= half))
    merged = tables.vault_merge(vault, s.where(F.col("seq") > half))
    return merged.select("url", "title", "category", "popularity_score", "first_seen_at", "last_updated_at")


@register(
    """SELECT scan_job_id, min(r.id) AS id, category, max(views) AS views, max(likes) AS likes, max(hearts) AS hearts, any_value(t.tags) AS tags, count(*) AS merged
       FROM resources r JOIN (SELECT scan_job_id, category, string_agg(DISTINCT name, '|' ORDER BY name) AS tags FROM resource_tags JOIN resources USING (id, scan_job_id) GROUP BY 1, 2) t USING (scan_job_id, category) GROUP BY scan_job_id, category""",
    views.SQL,
)
def dedupe_dna(spark, sf_dir):
    r = views.resources(spark, sf_dir).withColumn("content_dna", F.col("category")).withColumn("seq", F.col("id"))
    return tables.dedupe_resources(r).select("scan_job_id", "id", "category", "views", "likes", "hearts", F.array_join("tags", "|").alias("tags"), "merged")


#: Rows in order, one a round and scan, each going to the first kept row of its title or category.
_SAVED = views.SQL + """, ordered AS (
    SELECT *, row_number() OVER (PARTITION BY scan_job_id ORDER BY id) AS r FROM resources
), saved(scan_job_id, r, id, leader, kept) AS (
    SELECT scan_job_id, r, id, id, [{'id': id, 't': title, 'c': category}] FROM ordered WHERE r = 1
    UNION ALL
    SELECT scan_job_id, r, id, coalesce(met, id), CASE WHEN met IS NULL THEN list_append(kept, {'id': id, 't': title, 'c': category}) ELSE kept END FROM (
        SELECT o.*, saved.kept, list_filter(saved.kept, lambda x: x.t = o.title OR x.c = o.category)[1].id AS met FROM saved JOIN ordered o ON o.scan_job_id = saved.scan_job_id AND o.r = saved.r + 1
    )
)"""


@register("SELECT scan_job_id, leader AS id, count(*) AS merged, max(r.views) AS views FROM saved JOIN (SELECT id, views FROM resources) r USING (id) GROUP BY 1, 2", _SAVED)
def dedupe_either(spark, sf_dir):
    """By title or signature, whichever meets a kept row first."""
    r = views.resources(spark, sf_dir).withColumn("content_dna", F.col("category")).withColumn("seq", F.col("id"))
    return tables.dedupe_resources(r, "either").select("scan_job_id", "id", "merged", "views")


@register(
    """SELECT url, title, category, popularity_score, tags FROM (SELECT id, url, title, category, popularity_score, published_at FROM scored)
       JOIN (SELECT id, string_agg(name, ', ' ORDER BY name) AS tags FROM resource_tags GROUP BY 1) USING (id) ORDER BY url""",
    SCORED,
)
def vault_sync(spark, sf_dir):
    """All resources into an empty vault, twice; the second time changes nothing. Listed by time of change, then URL."""
    r = _scored(spark, sf_dir).withColumns({"cover_url": F.lit(""), "content_fingerprint": F.lit("")})
    at = F.lit(NOW).cast("timestamp")
    once = tables.vault_sync(None, r, views.resource_tags(spark, sf_dir), at)
    return tables.vault_recent(tables.vault_sync(once, r, views.resource_tags(spark, sf_dir), at)).select("url", "title", "category", "popularity_score", "tags")


@register("SELECT user_id AS scan_job_id, event_type AS url, min(event_id) AS id FROM events WHERE event_type IN ('view', 'click') AND user_id % 3 = 0 GROUP BY 1, 2")
def page_ids_semi(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_job_id"), F.col("event_type").alias("url"), F.col("event_id").alias("id"))
    return tables.known_pages(e, e.where("url in ('view', 'click') and scan_job_id % 3 = 0").unionByName(e.limit(1).withColumn("url", F.lit("absent"))))


@register("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'done' ELSE c_mktsegment END AS status, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE c_nationkey END::INTEGER AS n FROM customer")
def job_update(spark, sf_dir):
    """Two changes of a quarter of the rows; the later one leaves a column as the first set it."""
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_nationkey").alias("n"))
    some = c.where("id % 4 = 0").select("id", F.lit("done").alias("status"), F.lit(1).alias("n"), F.lit(1).alias("seq"))
    return tables.updated(c, some.unionByName(some.select("id", F.lit(None).cast("string").alias("status"), F.lit(2).alias("n"), F.lit(2).alias("seq"))))


@register("SELECT id, created_at FROM scan_jobs", views.SQL)
def jobs_recent(spark, sf_dir):
    return tables.newest_first(views.scan_jobs(spark, sf_dir))


@register("SELECT 'https://shop.example/' || p_partkey AS entry_url, 'shop.example' AS domain, CASE WHEN p_size > 25 THEN p_size ELSE 200 END::INTEGER AS max_pages, 3 AS max_depth, 'pending' AS status FROM part WHERE p_partkey % 3 > 0")
def scan_start(spark, sf_dir):
    """Requests without a scheme, some with a limit; a third of them go to a private host."""
    host = F.when(F.col("p_partkey") % 3 == 0, "localhost/").otherwise("shop.example/")
    return tables.scan_start(views.table(spark, sf_dir, "part").select(F.concat(host, "p_partkey").alias("url"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("max_pages"), F.lit(None).cast("int").alias("max_depth")))


@register("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 1 THEN 9 END::BIGINT AS last_scanned_at FROM customer WHERE c_custkey % 5 > 0")
def watchlist_apply(spark, sf_dir):
    """A fifth is deleted, a fifth touched twice."""
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("last_scanned_at"))
    command = lambda left, name, at: c.where(F.col("id") % 5 == left).select("id", F.lit(name).alias("command"), F.lit(at).cast("long").alias("at"), F.lit(at).alias("seq"))
    return tables.watchlist_apply(c, command(0, "delete", 1).unionByName(command(0, "touch", 2)).unionByName(command(1, "touch", 9)).unionByName(command(1, "touch", 5)))


@register("SELECT event_id AS id, user_id AS scan_job_id, floor(value)::BIGINT AS views, NULL::VARCHAR AS title FROM events")
def schema_conform(spark, sf_dir):
    """Columns that are missing are null, others go, kinds are cast."""
    e = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("scan_job_id"), F.floor("value").cast("string").alias("views"), "props")
    return tables.conform(e, {"id": "long", "scan_job_id": "long", "views": "long", "title": "string"})


@register("SELECT 'resources' AS name, count(*) AS n FROM resources WHERE scan_job_id <> 7 UNION ALL SELECT 'scan_jobs', count(*) FROM scan_jobs WHERE id <> 7 UNION ALL SELECT 'resource_tags', count(*) FROM resource_tags WHERE scan_job_id <> 7", views.SQL)
def cascade_delete(spark, sf_dir):
    kept = tables.cascade_delete({"resources": views.resources(spark, sf_dir), "scan_jobs": views.scan_jobs(spark, sf_dir), "resource_tags": views.resource_tags(spark, sf_dir)}, 7)
    one = lambda n: kept[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one("resources").unionByName(one("scan_jobs")).unionByName(one("resource_tags"))


def _cache(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").where("event_type = 'view'")
    return e.select(F.col("user_id").cast("string").alias("url"), F.md5(F.col("event_id").cast("string")).alias("etag"), F.col("event_id").alias("size_bytes"), F.col("ts").alias("cached_at"), F.col("event_id").alias("seq"))


_CACHE = "cache AS (SELECT user_id::VARCHAR AS url, max_by(md5(event_id::VARCHAR), event_id) AS etag, max(event_id) AS size_bytes, max_by(ts, event_id) AS cached_at FROM events WHERE event_type = 'view' GROUP BY 1)"


@register("SELECT url, etag, size_bytes FROM cache WHERE cached_at >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY", _CACHE)
def cache_ttl(spark, sf_dir):
    return tables.cache_alive(tables.cache_upsert(None, _cache(spark, sf_dir)), F.lit("2024-01-30").cast("timestamp")).select("url", "etag", "size_bytes")


@register("SELECT count(*) AS entries, sum(size_bytes)::BIGINT AS bytes FROM cache", _CACHE)
def cache_metrics(spark, sf_dir):
    return tables.cache_metrics(tables.cache_upsert(None, _cache(spark, sf_dir)))


@register("SELECT c_mktsegment AS url, max_by(c_name, c_custkey) AS label, max_by(c_nationkey, c_custkey)::INTEGER AS frequency_hours, min(c_custkey) AS created_at FROM customer GROUP BY 1")
def watchlist(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("url"), F.col("c_name").alias("label"), F.col("c_nationkey").alias("frequency_hours"), F.col("c_custkey").alias("created_at"), F.col("c_custkey").alias("seq"))
    return tables.watchlist_upsert(None, c)


@register("SELECT site AS domain, count(*) AS success_count, max_by(scheme, page_id) AS container_selector, min_by(path, page_id) AS title_selector, max(page_id) AS last_updated FROM urls GROUP BY 1", _PAGE_URLS)
def site_profile(spark, sf_dir):
    u = F.col("url")
    p = views.table(spark, sf_dir, "pages").select(urls.site(u).alias("domain"), urls.scheme(u).alias("container_selector"), urls.path(u).alias("title_selector"), F.col("page_id").alias("saved_at"), F.col("page_id").alias("seq"))
    return tables.site_profiles(p)


# Monitoring


@register("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def event_counts(spark, sf_dir):
    return monitor.event_counts(views.table(spark, sf_dir, "events"))


@register("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed, round(100 * count(*) FILTER (WHERE event_type = 'error') / count(*), 2) AS failure_rate FROM events")
def failure_rate(spark, sf_dir):
    return monitor.failure_rate(views.table(spark, sf_dir, "events"), "error")


def _crawl(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "pending").otherwise("fetched")
    return e.select(F.col("user_id").alias("scan_job_id"), status.alias("status"), F.concat(F.lit("r"), F.col("event_id") % 3).alias("failure_reason"), F.col("value").alias("page_ms"), "event_id", "ts")


_CRAWL = "crawl AS (SELECT user_id AS scan_job_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'pending' ELSE 'fetched' END AS status, 'r' || event_id % 3 AS failure_reason, value AS page_ms, event_id, ts FROM events)"


@register("SELECT scan_job_id, count(*) AS pages, count(*) FILTER (WHERE status = 'failed') AS failed, coalesce(max(n), 0) AS resources FROM crawl LEFT JOIN (SELECT p_size::BIGINT AS scan_job_id, count(*) AS n FROM part GROUP BY 1) USING (scan_job_id) GROUP BY 1", _CRAWL)
def job_stats(spark, sf_dir):
    r = views.resources(spark, sf_dir).withColumn("scan_job_id", F.col("scan_job_id").cast("long"))
    return monitor.job_stats(_crawl(spark, sf_dir), r).drop("avg_page_ms")


@register(
    """SELECT scan_job_id, fetched, pending, failed, coalesce(top_reason, '') AS top_reason, CASE WHEN failed > 0 THEN 'failed: ' || top_reason WHEN fetched > 0 THEN 'fetched without resources' WHEN pending > 0 THEN 'not started' ELSE 'no pages' END AS verdict FROM (
        SELECT scan_job_id, count(*) FILTER (WHERE status = 'fetched') AS fetched, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'failed') AS failed FROM crawl GROUP BY 1
    ) LEFT JOIN (SELECT scan_job_id, first(failure_reason ORDER BY n DESC, failure_reason) AS top_reason FROM (SELECT scan_job_id, failure_reason, count(*) AS n FROM crawl WHERE status = 'failed' GROUP BY 1, 2) GROUP BY 1) USING (scan_job_id)""",
    _CRAWL,
)
def diagnosis(spark, sf_dir):
    return monitor.diagnosis(_crawl(spark, sf_dir))


@register("SELECT scan_job_id, first(status ORDER BY (status = 'failed') DESC, event_id DESC) AS status, first(event_id ORDER BY (status = 'failed') DESC, event_id DESC) AS event_id FROM crawl GROUP BY 1", _CRAWL)
def progress_latest(spark, sf_dir):
    return monitor.latest_progress(_crawl(spark, sf_dir).select("scan_job_id", "status", "event_id"), "scan_job_id", "event_id")


@register("SELECT scan_job_id, CASE WHEN status = 'pending' THEN 'pending' ELSE 'visited' END AS state, count(*) AS n FROM crawl GROUP BY 1, 2", _CRAWL)
def resume_split(spark, sf_dir):
    return frontier.resume_split(_crawl(spark, sf_dir))


@register("SELECT (SELECT count(*) FROM part) AS resources, (SELECT count(DISTINCT p_size) FROM part) AS jobs, (SELECT count(*) FROM crawl WHERE status = 'failed') AS failed_pages, (SELECT count(DISTINCT scan_job_id) FROM crawl WHERE status = 'pending') AS active_jobs, (SELECT count(DISTINCT name) FROM resource_tags) AS tag_names", views.SQL + ", " + _CRAWL)
def ops_metrics(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").agg(F.count("*").alias("resources"), F.countDistinct("p_size").alias("jobs"))
    c = _crawl(spark, sf_dir).agg(F.count_if(F.col("status") == "failed").alias("failed_pages"), F.countDistinct(F.when(F.col("status") == "pending", F.col("scan_job_id"))).alias("active_jobs"))
    t = views.resource_tags(spark, sf_dir).agg(F.countDistinct("name").alias("tag_names"))
    return p.join(c).join(t)


@register("SELECT user_id, max(ts) AS ts, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_by_key(spark, sf_dir):
    return tables.latest_by(views.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").select("user_id", "ts", "event_type")


# Frontier


@register(
    """SELECT page_id, normal AS url, (50 + CASE WHEN regexp_matches(lower(path), '/(?:archives|v|p|post|item|product|video|article|detail)/\\d+|/\\d+\\.html$|/v/|/p/') THEN 30 ELSE 0 END + 15 + CASE WHEN regexp_matches(lower(path), '\\.html?$') THEN 10 ELSE 0 END)::BIGINT AS score
       FROM urls ORDER BY score DESC, url, page_id LIMIT 50""",
    _PAGE_URLS,
)
def frontier_batch(spark, sf_dir):
    u = urls.normalize(F.col("url"))
    f = views.table(spark, sf_dir, "pages").select("page_id", u.alias("url"), F.lit(0).alias("depth"), urls.priority(F.col("url"), F.lit(0)).cast("long").alias("score"))
    return frontier.next_batch(f, 50).select("page_id", "url", "score")


@register(
    """SELECT node, min(depth) AS depth FROM walk GROUP BY 1""",
    "walk AS (SELECT 1::BIGINT AS node, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM walk JOIN (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 1) ON src = node WHERE depth < 6)",
)
def bfs_crawl(spark, sf_dir):
    edges = views.table(spark, sf_dir, "part").where("p_partkey > 1").select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst"))
    seeds = spark.range(1, 2).select(F.col("id").alias("node"))
    return frontier.reachable(edges, seeds, 6)


# Fetching, over tables


@register(
    """SELECT event_id, 'data/assets/' || event_id % 7 || '/' || md5('https://c.example/' || event_id || '.png') || '.png' AS path,
              CASE WHEN event_id % 3 = 0 THEN 'data/assets/' || event_id % 7 || '/' || md5('https://c.example/' || event_id || '.png') || '.png' ELSE 'https://c.example/' || event_id || '.png' END AS shown FROM events"""
)
def assets(spark, sf_dir):
    """A third of all covers is kept, another third too small."""
    e = views.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7).alias("scan_job_id"), F.concat(F.lit("https://c.example/"), "event_id", F.lit(".png")).alias("cover_url"))
    path = fetched.asset_path(F.col("scan_job_id"), F.col("cover_url"))
    kept = e.where("event_id % 3 < 2").select(path.alias("path"), (F.lit(201) - 100 * (F.col("event_id") % 3)).alias("size"))
    return fetched.asset_or_url(e, kept).select("event_id", path.alias("path"), "shown")


@register(
    """SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'cached' ELSE event_type END AS body, event_id % 4 = 0 AS cached FROM events"""
)
def cached_bodies(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    responses = e.select(F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("url"), F.when(F.col("event_id") % 4 == 0, 304).otherwise(200).alias("status"), F.col("event_type").alias("body"))
    cache = e.select(F.col("event_id").cast("string").alias("url"), F.lit("cached").alias("response_body"))
    return fetched.with_cached(responses, cache).select("id", "body", "cached")


@register(
    """SELECT p_partkey::VARCHAR AS url, (p_partkey - 5 * least(3, greatest(0, p_partkey - 1) // 5))::VARCHAR AS final_url FROM part""",
)
def redirects(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    hops = p.where("p_partkey > 5").select(F.col("p_partkey").cast("string").alias("url"), (F.col("p_partkey") - 5).cast("string").alias("location"))
    return fetched.final_urls(hops, p.select(F.col("p_partkey").cast("string").alias("url")), 3).select("url", "final_url")


@register(
    r"""SELECT page_id, regexp_matches(lower(url), 'google-analytics|doubleclick|adservice|adsense|analytics\.js|facebook\.net|facebook\.com/plugins|googletagmanager|googletagservices|amazon-adsystem|adnxs|scorecardresearch|tracking|pixel|analytics|metrics|ads-|ads\.|/ads/|advertisement') AS blocked,
               path NOT LIKE '/a%' AS allowed FROM urls""",
    _PAGE_URLS,
)
def refused_requests(spark, sf_dir):
    """Block list, and robots rules of every host that refuse paths that begin with a."""
    p = views.table(spark, sf_dir, "pages").select("page_id", "url")
    rules = p.select(urls.netloc(F.col("url")).alias("host")).distinct().withColumn("robots", F.lit("User-agent: *\nDisallow: /a"))
    checked = fetched.robots_allowed(p, rules)
    return checked.select("page_id", fetched.is_blocked(F.col("url"), F.lit("document")).alias("blocked"), "allowed")


#: Events of a user one after the other, one a round, with the state of pacing.
_PACING = """log AS (
    SELECT user_id::VARCHAR AS domain, event_id AS seq, floor(epoch(ts)) AS tick, CASE event_type WHEN 'error' THEN '429' WHEN 'click' THEN 'failed' ELSE 'ok' END AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS r FROM events
), step(domain, r, seq, rate, last, fails, until, open) AS (
    SELECT domain, 0::BIGINT, 0::BIGINT, 2::DOUBLE, -1e18::DOUBLE, 0, -1e18::DOUBLE, FALSE FROM log WHERE r = 1
    UNION ALL
    SELECT domain, r, seq, CASE WHEN outcome = '429' AND tick - last > 1 THEN greatest(0.1::DOUBLE, eased / 2) ELSE eased END, CASE WHEN outcome = '429' AND tick - last > 1 THEN tick ELSE last END,
           CASE WHEN outcome = 'ok' THEN 0 ELSE fails + 1 END, CASE WHEN outcome = 'failed' AND fails + 1 >= 10 THEN tick + 300 ELSE until END, tick < until FROM (
        SELECT l.domain, l.r, l.seq, l.outcome, l.tick, s.last, s.fails, s.until, CASE WHEN l.tick - s.last > 10 AND s.rate < 2 THEN least(2::DOUBLE, s.rate + 0.1::DOUBLE) ELSE s.rate END AS eased
        FROM step s JOIN log l ON l.domain = s.domain AND l.r = s.r + 1
    )
)"""


@register("SELECT domain, seq, round(rate, 6) AS rate, open FROM step WHERE r > 0", _PACING)
def pacing(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "error", "429").when(F.col("event_type") == "click", "failed").otherwise("ok")
    return fetched.replay_pacing(e.select(F.col("user_id").cast("string").alias("domain"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("ts"), outcome.alias("outcome")))


@register("SELECT site AS domain, regexp_replace(path, '/\\d+', '/*', 'g') AS pattern, max_by('s' || page_id, page_id) AS selector FROM urls GROUP BY 1, 2", _PAGE_URLS)
def page_memory(spark, sf_dir):
    p = views.table(spark, sf_dir, "pages").select("url", F.concat(F.lit("s"), "page_id").alias("selector"), F.col("page_id").alias("seq"))
    return fetched.page_memory(p)


# Export


_RAW = '{"provenance":{"title":"dom","bad":"x","category":"jsonld"},"description":"d"}'


def _export(spark, sf_dir):
    raw = F.when(F.col("id") % 3 == 0, _RAW).when(F.col("id") % 3 == 1, "not json")
    return _scored(spark, sf_dir).withColumns({"cover_url": F.lit(""), "raw_data": raw, "tags": F.array_sort("tags")})


@register(
    """SELECT id, title, url, '' AS cover_url, views, likes, hearts, category, published_at, popularity_score, t AS tags,
              CASE WHEN id % 3 = 0 THEN '{"category":"jsonld","title":"dom"}' ELSE '{}' END AS sources
       FROM scored JOIN (SELECT id, string_agg(name, '; ' ORDER BY name) AS t FROM resource_tags GROUP BY 1) USING (id)""",
    SCORED,
)
def export_csv(spark, sf_dir):
    return export.resource_rows(_export(spark, sf_dir))


@register(
    """SELECT id, title, tags, CASE WHEN id % 3 = 0 THEN 'd' ELSE '' END AS description, CASE WHEN id % 3 = 0 THEN 'dom' END AS title_from
       FROM resources JOIN (SELECT id, string_agg(name, '|' ORDER BY name) AS tags FROM resource_tags GROUP BY 1) USING (id)""",
    views.SQL,
)
def export_json(spark, sf_dir):
    """The written lines, read back."""
    back = F.from_json("value", "id long, title string, tags array<string>, provenance map<string,string>, description string")
    return export.resource_json(_export(spark, sf_dir)).select(back.alias("r")).select("r.id", "r.title", F.array_join("r.tags", "|").alias("tags"), "r.description", F.try_element_at("r.provenance", F.lit("title")).alias("title_from"))


@register(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'dom' WHEN event_id % 4 = 1 THEN 'jsonld' END AS title_from, CASE WHEN event_id % 4 < 2 THEN 'd' || event_id ELSE '' END AS description,
              CASE event_id % 4 WHEN 0 THEN '{"description":"d' || event_id || '","provenance":{"title":"dom"}}' WHEN 1 THEN '{"description":"d' || event_id || '","provenance":{"a":"dom","title":"jsonld"}}' ELSE '{"description":"","provenance":{}}' END AS written FROM events"""
)
def provenance_json(spark, sf_dir):
    """Stored JSON read and written again: unknown origins go, what can't be read is empty."""
    k, d = F.col("event_id") % 4, F.concat(F.lit('{"provenance":{"title":"'), F.when(F.col("event_id") % 4 == 0, "dom").otherwise("jsonld"), F.when(F.col("event_id") % 4 == 0, '","b":"other"').otherwise('","a":"dom"'), F.lit('},"description":"d'), F.col("event_id"), F.lit('"}'))
    raw = F.when(k < 2, d).when(k == 2, "[1, 2").when(k == 3, F.lit(None).cast("string"))
    read = export.read_raw_data(raw)
    return views.table(spark, sf_dir, "events").select("event_id", F.try_element_at(read["provenance"], F.lit("title")).alias("title_from"), read["description"].alias("description"), export.write_raw_data(read["provenance"], read["description"]).alias("written"))


@register("SELECT scan_job_id, name, resource_count FROM tags", views.SQL)
def export_tags(spark, sf_dir):
    """Tag lines as JSON, read back."""
    t = _tag_counts(spark, sf_dir).withColumn("id", F.col("scan_job_id"))
    return export.tag_json(t).select(F.from_json("value", "id int, name string, resource_count long").alias("r")).select(F.col("r.id").alias("scan_job_id"), "r.name", "r.resource_count")


@register("SELECT event_id, user_id, event_type FROM events")
def export_events(spark, sf_dir):
    """Event lines as JSON, read back."""
    return export.event_json(views.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")).select(F.from_json("value", "event_id long, user_id long, event_type string").alias("r")).select("r.*")


# More of fetching


@register("SELECT event_id AS id, event_type AS body FROM events WHERE event_id % 3 > 0")
def readable_bodies(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("image/png"), F.lit("text/html; charset=utf-8"), F.lit("APPLICATION/XML ")), (F.col("event_id") % 3 + 1).cast("int"))
    return fetched.readable(views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind.alias("content_type"), F.col("event_type").alias("body"))).select("id", "body")


@register("SELECT event_id AS id, props AS body FROM events")
def inflated_bodies(spark, sf_dir):
    """Half of the bodies are stored deflated, half as they are."""
    import zlib

    @F.pandas_udf("binary")
    def deflated(s: pd.Series) -> pd.Series:
        return s.map(lambda t: zlib.compress(t.encode()) if isinstance(t, str) else None)

    raw = F.when(F.col("event_id") % 2 == 0, deflated("props")).otherwise(F.col("props").cast("binary"))
    return views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), fetched.inflated(raw).cast("string").alias("body"))


@register("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'rendered' WHEN 1 THEN 'static' ELSE 'static' END AS source, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN props ELSE '' END AS html FROM events")
def rendered_sources(spark, sf_dir):
    k = F.col("event_id") % 3
    e = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(k == 1, F.col("props")).when(k == 0, "").alias("html"), F.when(k < 2, F.col("event_type")).alias("rendered_html"))
    return fetched.rendered_where_needed(e)


@register("SELECT id AS page_id, CASE WHEN id % 2 = 0 THEN 'rendered' ELSE 'static' END AS source, 2 AS n FROM resources", views.SQL)
def render_rescue(spark, sf_dir):
    """Listings that gave no cards when fetched get those of the rendered page."""
    card = '<div class="card"><a href="/a{id}"><img src="/a.png"></a><h3>{title} one</h3></div><div class="card"><a href="/b{id}"><img src="/b.png"></a><h3>{title} two</h3></div>'
    full = _made(spark, sf_dir, "<html><body>", card * 4, "</body></html>", url="https://shop.example/list/")
    bare = _made(spark, sf_dir, "<html><body>", '<div class="card">{title}</div>' * 8, "</body></html>", url="https://shop.example/list/")
    static = full.where("page_id % 2 = 1").unionByName(bare.where("page_id % 2 = 0"))
    # Only the cards' URLs are looked at, so nothing else of them moves to where the parses meet.
    cards = lambda pages: extract.parsed(pages).withColumn("resources", F.transform("resources", lambda r: r["url"]))
    got = fetched.rescued(cards(static), cards(full.where("page_id % 2 = 0")))
    return got.select("page_id", "source", F.size(F.array_distinct("resources")).alias("n"))
