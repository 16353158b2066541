"""Keyed tables, the frontier and the parser's tree against plain loops."""

import random

from pyspark.sql import functions as F

from webskein.operators import frontier, tables
from webskein.sources import extract, htmltree


def test_dedupe_by_either_key_equals_saving_one_by_one(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        title, dna = rng.choice(["", "A b", "a-B", "c", "d", "e f", "g", f"t{rng.randrange(60)}"]), rng.choice(["", None, tables.LIST_ITEM_DNA, "T2", "T3", f"D{rng.randrange(60)}"])
        rows.append((i % 3, i, i, f"u{i}", title, "c", rng.randrange(9), rng.randrange(9), rng.randrange(9), dna, [f"x{rng.randrange(5)}", "y"]))
    made = spark.createDataFrame(rows, "scan_job_id int, seq long, id long, url string, title string, category string, views long, likes long, hearts long, content_dna string, tags array<string>")
    for mode in ("dna", "title", "either"):
        kept = {}
        for job, seq, i, _, title, _, views, likes, hearts, dna, names in rows:
            key_t = "".join(c for c in title.lower() if c.isalnum()) if mode != "dna" else ""
            key_d = (dna or "") if mode != "title" else ""
            key_d = "" if key_d == tables.LIST_ITEM_DNA else key_d
            met = next((k for k in kept if k[0] == job and (key_t and kept[k]["t"] == key_t or key_d and kept[k]["d"] == key_d)), None)
            if met is None:
                kept[(job, i)] = {"t": key_t, "d": key_d, "n": 1, "v": (views, likes, hearts), "tags": set(names)}
            else:
                k = kept[met]
                k["n"], k["v"], k["tags"] = k["n"] + 1, tuple(map(max, k["v"], (views, likes, hearts))), k["tags"] | set(names)
        got = {(r.scan_job_id, r.id): (r.merged, (r.views, r.likes, r.hearts), r.tags) for r in tables.dedupe_resources(made, mode).collect()}
        assert got == {k: (v["n"], v["v"], sorted(v["tags"])) for k, v in kept.items()}, mode
    assert tables.dedupe_resources(made.limit(0), "either").count() == 0


def test_page_cap(spark):
    assert frontier.page_cap(5) == 10_000 and frontier.page_cap(2000) == 20_000
    links = spark.createDataFrame([(f"https://e.com/a{i}", 1) for i in range(20)] + [("https://other.com/x", 1), ("https://e.com/login", 1), ("https://e.com/deep", 9)], "url string, depth int")
    seen = spark.createDataFrame([("https://e.com/a3",)], "url string")
    all_links = frontier.new_links(links, seen, F.lit("https://e.com/"))
    assert all_links.count() == 19
    few = spark.range(10_000 - 5).select(F.concat(F.lit("https://e.com/seen"), "id").alias("url"))
    assert [r.url for r in frontier.new_links(links, few, F.lit("https://e.com/"), max_pages=10).collect()] == sorted(f"https://e.com/a{i}" for i in range(20))[:5]


def test_next_batch_has_a_total_order(spark):
    rows = spark.createDataFrame([(i, "https://e.com/x", 1, 50) for i in range(9)], "page_id long, url string, depth int, score int")
    assert [r.page_id for r in frontier.next_batch(rows.repartition(3), 4).collect()] == [0, 1, 2, 3]


def test_housekeeping(spark, tmp_path):
    cache = spark.createDataFrame([("a", "2024-01-29"), ("b", "2024-01-01")], "url string, at string").select("url", F.to_timestamp("at").alias("cached_at"))
    left = tables.housekeeping(cache, f"{tmp_path}/cache", F.lit("2024-01-30").cast("timestamp"))
    assert [r.url for r in left.collect()] == ["a"] and len(list((tmp_path / "cache").glob("part-*"))) == 1


def test_newest_first_and_states(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", "pending"), (2, "2024-02-01", "failed"), (3, "2024-02-01", "pending")], "id int, created_at string, status string")
    assert [r.id for r in tables.newest_first(rows).collect()] == [3, 2, 1]
    assert tables.with_status(rows, "failed").count() == 1 and tables.with_status(rows).count() == 3


def test_subtrees_are_slices():
    root = htmltree.parse("<div><p>a<b>c</b><p>d<ul><li>e<li>f</ul></div><section><img><div>x<script>y</script></div></section>tail")

    def walk(n):
        for c in n.children:
            if isinstance(c, htmltree.Node):
                yield c
                yield from walk(c)

    for n in [root, *root]:
        assert list(n) == list(walk(n))


def test_densest_block_equals_a_plain_search():
    rng = random.Random(2)

    def block(depth):
        inner = "".join(block(depth - 1) if depth and rng.random() < 0.6 else rng.choice(("text " * rng.randrange(9), '<a href="/x">link</a>', "<script>no text</script>", "<p>more</p>")) for _ in range(3))
        name = rng.choice(("div", "section", "article", "span"))
        return f"<{name}>{inner}</{name}>"

    for _ in range(40):
        page = extract.Page("https://e.com/", htmltree.parse("<html><body>" + block(4) + block(3) + "</body></html>"))
        body = page.root.first("body")
        score = lambda n: len(n.text()) / (len(n.all("a")) + 1) * (1 + 0.05 * n.depth)
        best = max(body.all("div", "section", "article"), key=score, default=None)
        assert extract.densest(page) is (best if best is not None and score(best) > 0 else None)


def test_modular_engine_reads_jsonld_in_order():
    html = """<script type="application/ld+json">{"headline": "one", "image": ["https://e.com/1.jpg"]}</script>
    <script type="application/ld+json">[{"@type": "VideoObject", "name": "two", "interactionStatistic": [{"interactionType": "WatchAction", "userInteractionCount": "x"}]}, {"name": "never"}]</script>
    <meta property="og:title" content="og"><meta name="twitter:image" content="https://e.com/t.jpg"><body><p>text</p></body>"""
    row = extract.parse_page(html, "https://e.com/a", "modular")["resources"][0]
    assert (row["title"], row["cover_url"], row["views"]) == ("two", "https://e.com/1.jpg", 0)
    assert row["provenance"]["title"] == "jsonld" and row["provenance"]["views"] == "missing"


def test_vault_sync_takes_tags_from_their_table(spark):
    """Resources may have a column of tags of their own; it is not read."""
    r = spark.createDataFrame([(1, "u1", "a", "", "c", "", 2.0, ["no"]), (2, "u2", "b", "", "c", "", 1.0, ["no"])], "id long, url string, title string, cover_url string, category string, content_fingerprint string, popularity_score double, tags array<string>")
    t = spark.createDataFrame([(1, "y"), (1, "x"), (1, "x")], "id long, name string")
    at = F.lit("2024-01-01").cast("timestamp")
    once = tables.vault_sync(None, r, t, at)
    for got in (once, tables.vault_sync(once, r, t, at)):
        assert sorted((v.url, v.tags, v.popularity_score) for v in got.collect()) == [("u1", "x, y", 2.0), ("u2", "", 1.0)]


def test_the_whole_vault_is_listed(spark):
    """More rows than a page shows: none is left out, and they come in order."""
    vault = spark.range(2_500).select(F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("url"), F.timestamp_seconds(F.col("id") % 3).alias("last_updated_at"))
    got = [r.url for r in tables.vault_recent(vault).collect()]
    assert got == [f"u{i:04}" for left in (2, 1, 0) for i in range(2_500) if i % 3 == left]
