"""Operators on small tables, worked by hand or against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from webskein.functions import pages, text, urls
from webskein.operators import frontier, monitor, scores, search, similar, tables, tags
from webskein.sources import extract
from webskein.streaming import events as streaming


def col(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("HTTPS://Ex.COM", "https://ex.com/"), ("http://e.com/a/", "http://e.com/a"), ("http://e.com/a//?q=1#f", "http://e.com/a?q=1"),
        ("https://例え.jp/道/", "https://例え.jp/道"), ("https://e.com/a b", "https://e.com/a b"), ("https://e.com?x=/", "https://e.com/?x=/"),
    ],
)
def test_normalize(spark, raw, wanted):
    assert col(spark, [raw], urls.normalize) == [wanted]


def test_entry_urls(spark):
    given = ["e.com", " HTTP://E.com/a ", "//e.com", "mailto:x@y.z", "ftp://e.com", "", "a b.com", "localhost:80", "http://10.1.2.3/", "https://8.8.8.8/x", None]
    assert col(spark, given, urls.entry_url) == ["https://e.com", "http://E.com/a", "https://e.com", None, None, None, None, None, None, "https://8.8.8.8/x", None]


def test_private_hosts(spark):
    hosts = ["10.0.0.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "169.254.169.254", "127.0.0.1", "8.8.8.8", "localhost", "[::1]", "fe80::1", "example.com", ""]
    wanted = [True, True, False, True, True, True, False, True, True, True, False, False]
    assert col(spark, hosts, urls.is_private_host) == wanted
    assert col(spark, hosts, urls.is_private_name) == wanted


def test_numbers_dates_titles(spark):
    assert col(spark, ["views 1,234", "12.3K", "2.3万", "none", "1 234 567", "5M"], text.metric_number) == [1234, 12300, 23000, None, 1234567, 5000000]
    assert col(spark, ["2025-3-5T10", "on 2024/12/31.", "2025年3月15日", "1969-01-01", "2024-13-01", ""], text.date_of) == ["2025-03-05", "2024-12-31", "2025-03-15", "", "", ""]
    assert col(spark, ["A｜B｜C", "GRACE-029 | S", "x"], lambda c: text.strip_site(c, True)) == ["A", "GRACE-029 | S", "x"]
    assert col(spark, ["a.jpg 1x, b.jpg 2x", "a.jpg, b.jpg", "a 100w, b 50w", ""], text.srcset_best) == ["b.jpg", "a.jpg", "a", ""]
    assert col(spark, ["0000000000000000", "xyz", None], lambda c: text.hamming(c, F.lit("000000000000000f"))) == [4, 64, 64]


def test_classes_and_failures(spark):
    assert col(spark, ["anime video video", "nothing", "manga anime"], lambda c: text.category(c, F.array())) == ["Movie", "Other", "Anime"]
    rows = spark.createDataFrame([("http", 403, "x Cloudflare"), ("http", 403, None), ("http", 502, ""), ("ssl", None, None), ("odd", None, None)], "e string, s int, b string")
    assert [r[0] for r in rows.select(pages.failure_class(F.col("e"), F.col("s"), F.col("b"))).collect()] == ["waf_blocked", "forbidden", "http_502", "ssl_error", "fetch_failed"]
    assert col(spark, ["", "x" * 2000, "__NEXT_DATA__" + "x" * 2000, None], pages.needs_js) == [True, False, True, True]


def test_simhash_equals_the_loop(spark):
    from hashlib import sha256

    def loop(t):
        words = t.lower().split()
        votes = [0] * 64
        for g in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
            h = int.from_bytes(sha256(g.encode()).digest()[:8], "big")
            for i in range(64):
                votes[i] += 1 if h >> i & 1 else -1
        return f"{sum(1 << i for i, v in enumerate(votes) if v > 0):016x}"

    given = ["", "  ", "one", "a b c a b", "Ünï cödé  text", "word " * 500, None]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    got = [r["simhash"] for r in text.simhash(rows, "i", "t").orderBy("i").collect()]
    assert got == [loop(t or "") if (t or "").strip() else "0" * 16 for t in given]


def test_popularity_and_tags(spark):
    rows = spark.createDataFrame([(1, 1, 100, 10, 5, "", ["a", "b"]), (2, 1, 50, 20, 5, "", ["a"]), (3, 1, 0, 0, 0, "2024-03-01", ["a", "b", "b"])], "id long, scan_job_id int, views long, likes long, hearts long, published_at string, tags array<string>")
    scored = scores.popularity(rows, F.lit("2024-03-01 12:00:00").cast("timestamp"))
    assert [r["popularity_score"] for r in scored.orderBy("id").collect()] == [80.0, 75.0, 10.0]
    assert [(r.tag_a, r.tag_b, r.n) for r in tags.cooccurrence(rows).collect()] == [("a", "b", 2)]
    assert [(r.tag, r.id) for r in scores.top_per_tag(scored, 1).orderBy("tag").collect()] == [("a", 1), ("b", 1)]


def test_clusters_equal_the_loop(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(150):
        h = rng.choice(base)
        for _ in range(rng.randrange(12)):
            h ^= 1 << rng.randrange(64)
        rows.append((i, i % 2, rng.choice(["", "0" * 16]) if i % 15 == 0 else f"{h:016x}", float(rng.randrange(20))))
    got = {r["id"]: r["leader"] for r in similar.leader_clusters(spark.createDataFrame(rows, "id long, scan_job_id int, simhash string, popularity_score double")).collect()}
    wanted = {}
    for job in (0, 1):
        leaders = []
        for i, _, h, _ in sorted((r for r in rows if r[1] == job), key=lambda r: (-r[3], r[0])):
            near = [k for k, v in leaders if (int(h, 16) ^ v).bit_count() <= 15] if h not in ("", "0" * 16) else []
            wanted[i] = near[0] if near else i
            if not near and h:
                leaders.append((i, int(h, 16)))
    assert got == wanted


def test_search(spark):
    rows = spark.createDataFrame([(1, "big red fox runs", "x"), (2, "red foxes", "big red"), (3, "fox red", "y"), (4, None, None)], "id long, title string, category string")
    found = {r["id"]: r["snippet"] for r in search.search(rows, "red fox*").collect()}
    assert found == {1: "big <b>red</b> <b>fox</b> runs", 2: "<b>red</b> <b>foxes</b>"}
    assert search.search(rows, "*").count() == 0


def test_vault_and_tables(spark):
    schema = "url string, title string, cover_url string, category string, tags string, content_fingerprint string, popularity_score double, seen_at long, seq long"
    one = spark.createDataFrame([("u", "old", "c", "k", "t", "f1", 3.0, 1, 1), ("u", "", "", "", "", "f2", 5.0, 2, 2)], schema)
    vault = tables.vault_merge(None, one)
    row = tables.vault_merge(vault, spark.createDataFrame([("u", "new", "", "", "", "f3", 1.0, 9, 1)], schema)).first()
    assert (row.title, row.cover_url, row.content_fingerprint, row.popularity_score, row.first_seen_at, row.last_updated_at) == ("new", "c", "f1", 5.0, 1, 9)
    dup = spark.createDataFrame([(1, 1, "u1", "A b", "x", 1, 2, 3, "D", 1), (2, 1, "u2", "a-B", "x", 5, 1, 1, "D", 2), (3, 1, "u3", "c", "x", 1, 1, 1, tables.LIST_ITEM_DNA, 3), (4, 1, "u4", "d", "x", 1, 1, 1, tables.LIST_ITEM_DNA, 4)], "id long, scan_job_id int, url string, title string, category string, views long, likes long, hearts long, content_dna string, seq long")
    assert {(r.id, r.views, r.merged) for r in tables.dedupe_resources(dup).collect()} == {(1, 5, 2), (3, 1, 1), (4, 1, 1)}
    assert tables.dedupe_resources(dup, "title").count() == 3
    links = spark.createDataFrame([(1, 9), (3, 9)], "resource_id long, tag_id long")
    left = tables.cascade_delete({"resources": dup, "resource_tags": links, "global_vault": vault}, 1)
    assert left["resources"].count() == 0 and left["resource_tags"].count() == 0 and left["global_vault"].count() == 1


def test_monitor(spark):
    e = spark.createDataFrame([("FETCH_FAILED",), ("FETCH_FAILED",), ("SCAN_STARTED",)], "event_type string")
    assert monitor.failure_rate(e, "FETCH_FAILED").first()["failure_rate"] == 66.67
    assert monitor.failure_rate(e.limit(0), "x").first()["failure_rate"] == 0.0


def test_frontier(spark):
    links = spark.createDataFrame([("https://www.e.com/a/#x", 1), ("https://e.com/a", 2), ("https://e.com/login", 1), ("https://e.com/i.png", 1), ("https://o.com/", 1), ("https://e.com/v/7.html", 9), ("https://e.com/v/7.html", 2)], "url string, depth int")
    seen = spark.createDataFrame([("https://e.com/a",)], "url string")
    got = frontier.new_links(links, seen, F.lit("https://e.com/"))
    assert {(r.url, r.depth, r.score) for r in got.collect()} == {("https://www.e.com/a", 1, 60), ("https://e.com/v/7.html", 2, 95)}


HEAD = '<meta property="og:title" content="Og｜S｜B"><meta property="og:image" content="https://c.d/site-logo.png"><meta name="twitter:title" content="Tw">'
ARTICLE = '<article><h1>H</h1><img src="/p.jpg" width="800" height="600"><span>views 1.5K</span><time datetime="2025-01-02T00:00">x</time><a rel="tag" href="/t">T1</a></article>'


def test_extract_priorities():
    page = extract.parse_page(f"<html><head>{HEAD}</head><body>{ARTICLE}</body></html>", "https://e.com/cat/9")
    r = page["resources"][0]
    assert page["page_type"] == "detail"
    assert (r["title"], r["cover_url"], r["views"], r["published_at"], r["tags"], r["category"]) == ("Og", "https://e.com/p.jpg", 1500, "2025-01-02", ["T1"], "cat")
    assert (r["provenance"]["title"], r["provenance"]["cover_url"], r["provenance"]["likes"]) == ("opengraph", "dom", "missing")


def test_extract_jsonld_microdata_and_stuffing():
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"VideoObject","name":"V","image":{"url":"https://a.b/c.jpg"},"keywords":"' + ",".join(f"kw{i}" for i in range(24)) + '","interactionStatistic":[{"interactionType":"http://schema.org/LikeAction","userInteractionCount":7}]}]}</script>'
    r = extract.parse_page(f"<html><head>{ld}{HEAD}</head><body>{ARTICLE}</body></html>", "https://e.com/a/b")["resources"][0]
    assert (r["title"], r["cover_url"], r["likes"], r["tags"]) == ("V", "https://a.b/c.jpg", 7, ["T1"])
    micro = '<article itemscope itemtype="A"><h1 itemprop="headline">M</h1><div itemscope itemtype="P"><b itemprop="name">Author</b></div></article>'
    r = extract.parse_page(f"<html><body>{micro}<time></time></body></html>", "https://e.com/a/1")["resources"][0]
    assert (r["title"], r["provenance"]["title"]) == ("M", "microdata")


def test_extract_lists_and_links():
    cards = "".join(f'<div class="card"><a href="/w/{i}"><img data-src="/i/{i}.jpg" src="x.gif" alt="Long title {i}">1:0{i}</a></div>' for i in range(6))
    page = extract.parse_page(f"<html><body>{cards}<a href='#a'>x</a><a href='tel:1'>y</a></body></html>", "https://e.com/")
    assert page["page_type"] == "list" and [r["title"] for r in page["resources"]] == [f"Long title {i}" for i in range(6)]
    assert page["resources"][2]["cover_url"] == "https://e.com/i/2.jpg" and len(page["links"]) == 6
    assert extract.parse_page(" ", "u") == {"page_type": "other", "links": [], "resources": []}
    assert extract.parse_page("<p>views: 0 © 2010", "https://e.com/x", "modular")["page_type"] == "detail"


def test_extra_source(spark):
    rows = spark.createDataFrame([(1, "https://e.com/a/1", f"<html><head>{HEAD}</head><body>{ARTICLE}</body></html>")], "page_id long, url string, html string")
    own = {"first": lambda page: {"title": "Mine"}} | extract.SOURCES
    assert extract.resources(extract.parsed(rows, sources=own)).first()["title"] == "Mine"


def test_streams(spark, sf, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in")
    stream = streaming.read_events(spark, str(tmp_path / "in"))
    streaming.run_once(streaming.windowed_counts(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    counted = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0]
    total = spark.read.parquet(f"{sf}/events.parquet").count()
    assert 0 < counted <= total


def test_progress(spark, tmp_path):
    rows = [(1, 0, "running"), (1, 100, "running"), (1, 300, "running"), (1, 310, "completed"), (1, 900, "running"), (2, 0, "running")]
    frame = spark.createDataFrame([(j, m, s) for j, m, s in rows], "job int, ms long, status string").select("job", F.timestamp_millis("ms").alias("ts"), "status")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    shown = streaming.coalesce_progress(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    streaming.run_once(shown, str(tmp_path / "out"), str(tmp_path / "ck"))
    shown = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.job, r.ts.microsecond // 1000, r.status) for r in shown.collect()) == [(1, 0, "running"), (1, 300, "running"), (1, 310, "completed"), (2, 0, "running")]


def test_fetched_tables(spark):
    from webskein.sources import fetched

    hops = spark.createDataFrame([("a", "b"), ("b", "https://10.0.0.1/x"), ("c", "d")], "url string, location string")
    got = {r.url: (r.final_url, r.hops, r.refused) for r in fetched.final_urls(hops, spark.createDataFrame([("a",), ("c",), ("z",)], "url string")).collect()}
    assert got == {"a": ("b", 1, True), "c": ("d", 1, False), "z": ("z", 0, False)}
    assert col(spark, [b"plain", None], fetched.inflated, "binary") == [b"plain", None]
    paths = col(spark, ["https://c.d/a.PNG?x=.y", "https://c.d/a"], lambda c: F.substring(fetched.asset_path(F.lit(7), c), -4, 4))
    assert paths == [".PNG", ".jpg"]
    log = spark.createDataFrame([("d", 0, 0, "429"), ("d", 1, 0, "429"), ("d", 2, 5, "429"), ("d", 3, 20, "ok")] + [("f", i, i, "failed") for i in range(12)], "domain string, seq long, ts long, outcome string")
    paced = {(r.domain, r.seq): (r.rate, r.open) for r in fetched.replay_pacing(log).collect()}
    assert [paced["d", i][0] for i in range(4)] == [1.0, 1.0, 0.5, 0.6] and [paced["f", i][1] for i in (9, 10, 11)] == [False, True, True]
    two = "page_type string, links array<string>, resources array<string>"
    static = spark.createDataFrame([(1, "list", [], []), (2, "detail", [], ["r"])], f"page_id int, {two}")
    rendered = spark.createDataFrame([(1, "list", [], ["x"]), (2, "list", [], ["y"])], f"page_id int, {two}")
    assert {r.page_id: (r.resources, r.source) for r in fetched.rescued(static, rendered).collect()} == {1: (["x"], "rendered"), 2: (["r"], "static")}


def test_exports_and_table_function(spark, tmp_path):
    from webskein.operators import export

    raw = col(spark, ['{"provenance":{"a":"dom","b":"zzz"},"description":"d"}', "[1]", "", None], lambda c: F.to_json(export.read_raw_data(c)))
    assert raw == ['{"provenance":{"a":"dom"},"description":"d"}'] + ['{"provenance":{},"description":""}'] * 3
    rows = spark.createDataFrame([(1, "Comma, in title", ["tag, x", 'q"'])], "id int, title string, tags array<string>").select("id", "title", F.array_join("tags", "; ").alias("tags"))
    export.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "csv")).first()["tags"] == 'tag, x; q"'
    extract.register(spark)
    got = spark.sql(f"SELECT title FROM parse_html('<html><head>{HEAD}</head><body>{ARTICLE}</body></html>', 'https://e.com/a/1')")
    assert [r.title for r in got.collect()] == ["Og"]


def test_pacing_rounds_half_up(spark):
    """A rate with a half after its sixth digit goes up, as in SQL, whether that digit is odd or even."""
    from webskein.sources import fetched

    log = spark.createDataFrame([("d", i, 2.0 * i, "429") for i in range(2)], "domain string, seq long, ts double, outcome string")
    rates = lambda start: [r.rate for r in fetched.replay_pacing(log, rate=start).orderBy("seq").collect()]
    assert rates(4 * 0.5078125) == [1.015625, 0.507813]
    assert rates(4 * 0.5234375) == [1.046875, 0.523438]


def test_parses_are_handed_back_in_small_batches(spark):
    """However many pages come at once, each batch that goes back has a bounded number of them, and none is lost."""
    pages = spark.range(1_300).coalesce(1).selectExpr("id as page_id", "concat('https://e.com/', id) as url", "concat('<a href=/x', id, '>x</a>') as html")
    sizes = []

    class Kept:
        schema = pages.schema

        def select(self, *names):
            return self

        def mapInPandas(self, f, schema):
            sizes.extend(len(out) for out in f(iter([pages.toPandas()])))

    extract.parsed(Kept(), parts=("links",))
    assert max(sizes) <= extract.PAGES_AT_ONCE and sum(sizes) == 1_300
    got = extract.parsed(pages, parts=("links",)).collect()
    assert {r.page_id: r.links for r in got} == {i: [f"https://e.com/x{i}"] for i in range(1_300)}


def test_rescue_moves_only_urls(spark, sf):
    """Where static and rendered parses meet, whole resources are not moved."""
    from webskein.plans import catalogue

    plan = catalogue.QUERIES["render_rescue"](spark, sf)._jdf.queryExecution().optimizedPlan()
    joins = [n for n in (plan.apply(i) for i in range(60)) if n is not None and n.nodeName() == "Join" and "resources" in n.output().toString()]
    kinds = [n.output().apply(i).dataType().simpleString() for n in joins for i in range(n.output().size())]
    assert "array<string>" in kinds and not any("struct" in k for k in kinds)


def test_plain_markup_is_read_as_the_tokenizer_reads_it(monkeypatch):
    """Pieces that are taken at once, and any others among them, give the tree that the tokenizer alone gives; each link is joined once."""
    import re

    from webskein.sources import htmltree

    bits = ["<p>", "</p>", '<a href="/x" class="card">', "</a>", "text ", "<br>", "<IMG SRC='a.png'>", "&amp; ", "&lt", "<script>a<b></script>", "<!-- c -->", "<title>a<b</title>", "<", '<li x="a&gt;b">', "</LI >", "<h3>", "<div/>", "<b", '<i a="1"b>']
    shape = lambda n: (n.name, n.attrs, [c if isinstance(c, str) else shape(c) for c in n.children])
    rng = random.Random(4)
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(300)]
    quick = [shape(htmltree.parse(p)) for p in pages]
    asked = []
    monkeypatch.setattr(extract, "urljoin", lambda base, href, join=extract.urljoin: asked.append(href) or join(base, href))
    card = '<div class="card"><a href="/a"><img src="/a.png"></a><h3>a title of a card</h3></div>'
    assert len(extract.parse_page(card * 8, "https://e.com/list/1")["resources"]) == 8 and sorted(asked) == ["/a", "/a.png"]
    monkeypatch.setattr(htmltree, "PLAIN", re.compile("(?!)"))
    assert [shape(htmltree.parse(p)) for p in pages] == quick
