"""Keyed tables as folds: what upserts, deletes and look-ups come to over whole batches.

A batch carries its order in a sequence column, as later rows of a key meet what earlier
rows left. Results are DataFrames; the caller writes them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored


def insert_if_absent(existing: DataFrame, batch: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The rows of a batch that an insert would add: the first of each key that is not there yet."""
    columns = [c for c in batch.columns if c not in key]
    first = batch.groupBy(*key).agg(F.min_by(F.struct(*columns), seq).alias("__row")).select(*key, *[F.col(f"__row.{c}").alias(c) for c in columns])
    return first.select(batch.columns).join(existing.select(*key).distinct(), key, "left_anti")


def _last(column: str, seq: str) -> Column:
    """The last value that is not empty."""
    return F.max_by(F.when(F.coalesce(F.col(column), F.lit("")) != "", F.col(column)), F.when(F.coalesce(F.col(column), F.lit("")) != "", F.col(seq)))


def vault_merge(vault: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Rows by URL: text columns take the last value that is not empty, the score is the greatest, fingerprint and
    first_seen_at stay the first, last_updated_at becomes the last. batch: url, title, cover_url, category, tags,
    content_fingerprint, popularity_score, seen_at, seq; the vault: the same with first_seen_at, last_updated_at."""
    rows = batch.select("url", "title", "cover_url", "category", "tags", "content_fingerprint", "popularity_score", F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_updated_at"), F.col("seq").cast("long").alias("seq"))
    if vault is not None:
        rows = rows.unionByName(vault.withColumn("seq", F.lit(-1).cast("long")).select(rows.columns))
    text = [_last(c, "seq").alias(c) for c in ("title", "cover_url", "category", "tags")]
    out = rows.groupBy("url").agg(
        *text,
        F.min_by("content_fingerprint", "seq").alias("content_fingerprint"),
        F.max("popularity_score").alias("popularity_score"),
        F.min_by("first_seen_at", "seq").alias("first_seen_at"),
        F.max_by("last_updated_at", "seq").alias("last_updated_at"),
    )
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "cover_url", "category", "tags")})


#: The structural signature that every item of a list page has; it tells nothing apart.
LIST_ITEM_DNA = "T1_L1_I1_S0"


def dedupe_resources(rows: DataFrame, mode: str = "dna") -> DataFrame:
    """One row for each group of a scan: of equal content_dna ("dna"), of equal title fingerprints ("title"), or of either ("either").

    The first row by seq stays, its counters the greatest of the group's and tags, if rows
    have them, the sorted union; merged says how many rows it stands for. Blank keys and the signature of
    list items group nothing. With "either" rows come one after the other, as they are
    saved: a row goes to the first row kept so far that has its title or its signature,
    or is kept.
    """
    from ..functions.text import title_fingerprint

    keys = {"dna": F.col("content_dna"), "title": title_fingerprint(F.col("title"))}
    keys = {n: F.when((v != "") & (v != LIST_ITEM_DNA), v) for n, v in keys.items() if mode in (n, "either")}
    keyed = rows.withColumns({f"__{n}": v for n, v in keys.items()})
    if mode == "either":
        led = _first_come(keyed.select("scan_job_id", "seq", "__dna", "__title"))
        keyed = keyed.join(led, ["scan_job_id", "seq"])
        group = F.col("__leader").cast("string")
    else:
        group = F.coalesce(F.concat(F.lit("key:"), F.col(f"__{mode}")), F.concat(F.lit("row:"), F.col("seq")))
    kept, tags = ["id", "url", "title", "category"], []
    if "tags" in rows.columns:
        tags = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags")]
    out = keyed.withColumn("__key", group).groupBy("scan_job_id", "__key").agg(
        F.min_by(F.struct(*kept), "seq").alias("r"), F.max("views").alias("views"), F.max("likes").alias("likes"), F.max("hearts").alias("hearts"),
        *tags, F.count("*").alias("merged"),
    )
    return out.select("scan_job_id", *[F.col(f"r.{c}").alias(c) for c in kept], "views", "likes", "hearts", *(["tags"] if tags else []), "merged")


def _first_come(rows: DataFrame) -> DataFrame:
    """(scan_job_id, seq, __leader): the row that each goes to. Which rows are kept is found in rounds: of the open rows, one
    that is the first of both of its keys is kept, and those that share a key with it are not; few rounds leave none open."""
    names, row = ("__dna", "__title"), ["scan_job_id", "seq"]

    def beside(left: DataFrame, right: DataFrame, out: str) -> DataFrame:
        """left with the least seq of right in each of the two keys, as <out><key>."""
        for n in names:
            left = left.join(right.where(F.col(n).isNotNull()).groupBy("scan_job_id", n).agg(F.min("seq").alias(out + n)), ["scan_job_id", n], "left")
        return left

    open_rows, kept = stored(rows), []
    while open_rows.limit(1).count():
        first = beside(open_rows, open_rows, "first")
        leads = [F.coalesce(F.col(f"first{n}"), F.col("seq")) == F.col("seq") for n in names]
        kept.append(stored(first.where(leads[0] & leads[1]).select(*row, *names)))
        left = beside(open_rows.join(kept[-1].select(*row), row, "left_anti"), kept[-1], "to")
        open_rows = stored(left.where("to__dna is null and to__title is null").select(*row, *names))
    if not kept:
        return rows.select(*row, F.col("seq").alias("__leader"))
    led = beside(rows, reduce(DataFrame.unionByName, kept), "to")
    earlier = [F.when(F.col(f"to{n}") <= F.col("seq"), F.col(f"to{n}")) for n in names]
    return led.select(*row, F.coalesce(F.least(*earlier), F.col("seq")).alias("__leader"))


def vault_sync(vault: DataFrame | None, resources: DataFrame, resource_tags: DataFrame, seen_at: Column) -> DataFrame:
    """All resources there are, with their tags joined by ", ", merged into the vault in order of id. resources: id, url,
    title, cover_url, category, content_fingerprint, popularity_score, other columns are not read; resource_tags: id, name."""
    joined = resource_tags.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("tags"))
    own = resources.select("id", "url", "title", "cover_url", "category", "content_fingerprint", "popularity_score")
    batch = own.join(joined, "id", "left").withColumns({"tags": F.coalesce("tags", F.lit("")), "seen_at": seen_at, "seq": F.col("id")})
    return vault_merge(vault, batch.select("url", "title", "cover_url", "category", "tags", "content_fingerprint", "popularity_score", "seen_at", "seq"))


def vault_recent(vault: DataFrame) -> DataFrame:
    """The whole vault, rows that changed last first; of equals by URL."""
    return vault.orderBy(F.desc("last_updated_at"), "url")


def known_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(scan_job_id, url, id) of the wanted (scan_job_id, url) that are stored, the least id of each."""
    return pages.join(wanted.select("scan_job_id", "url").distinct(), ["scan_job_id", "url"], "left_semi").groupBy("scan_job_id", "url").agg(F.min("id").alias("id"))


def updated(rows: DataFrame, changes: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Rows with the columns that changes (key, seq, some columns) set, null leaving a column as it is; of several changes
    of a column the last. Changes of rows that are not there do nothing."""
    names = [c for c in changes.columns if c not in (key, seq)]
    last = changes.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"__{c}") for c in names])
    new = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in names}
    return rows.join(last, key, "left").select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


def pending_pages(pages: DataFrame) -> DataFrame:
    return pages.where("status = 'pending'").select("scan_job_id", "url", "depth", "id")


def with_status(rows: DataFrame, *wanted: str) -> DataFrame:
    """Rows of the given states; all without any."""
    return rows.where(F.col("status").isin(*wanted)) if wanted else rows


def newest_first(rows: DataFrame, at: str = "created_at", tie: str = "id") -> DataFrame:
    """Scans or watched URLs as they are listed: newest first, of equals the last added."""
    return rows.orderBy(F.desc(at), F.desc(tie))


def scan_start(wanted: DataFrame, max_pages: int = 200, max_depth: int = 3) -> DataFrame:
    """The scans that requests (url and, null for the default, max_pages, max_depth) start: entry_url, domain, max_pages,
    max_depth, status pending. A request whose URL can't be one, or whose limits are not positive, starts none."""
    from ..functions.urls import entry_url, netloc

    entry = F.expr("entry_url")
    rows = wanted.withColumn("entry_url", entry_url(F.col("url"))).where("entry_url is not null")
    rows = rows.select(entry, netloc(entry).alias("domain"), F.coalesce("max_pages", F.lit(max_pages)).alias("max_pages"), F.coalesce("max_depth", F.lit(max_depth)).alias("max_depth"), F.lit("pending").alias("status"))
    return rows.where("max_pages > 0 and max_depth >= 0")


def cascade_delete(tables: dict[str, DataFrame], job: int) -> dict[str, DataFrame]:
    """What is left of each table when a scan goes; tables without a scan column, such as the vault and the cache, stay whole."""
    own = {"scan_jobs": "id"}
    links = tables.get("resource_tags")
    out = {n: t.where(F.col(own.get(n, "scan_job_id")) != job) if own.get(n, "scan_job_id") in t.columns else t for n, t in tables.items()}
    if links is not None and "scan_job_id" not in links.columns and "resources" in tables:
        gone = tables["resources"].where(F.col("scan_job_id") == job).select(F.col("id").alias("resource_id"))
        out["resource_tags"] = links.join(gone, "resource_id", "left_anti")
    return out


def latest_by(rows: DataFrame, key: list[str], order: str, tie: str) -> DataFrame:
    """The last row of each key."""
    columns = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(order, tie)).alias("r"))
    return best.select(*key, *[F.col(f"r.{c}").alias(c) for c in columns])


def watchlist_upsert(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """By URL: label and frequency of the last row, the rest of the first. Columns url, label, frequency_hours, created_at, seq."""
    rows = batch if existing is None else batch.unionByName(existing.withColumn("seq", F.lit(-1).cast("long")))
    return rows.groupBy("url").agg(F.max_by("label", "seq").alias("label"), F.max_by("frequency_hours", "seq").alias("frequency_hours"), F.min_by("created_at", "seq").alias("created_at"))


def watchlist_apply(watched: DataFrame, commands: DataFrame) -> DataFrame:
    """The watchlist after commands (id, command, at, seq): "delete" takes a row away, "touch" sets last_scanned_at; nothing
    that follows a delete brings a row back."""
    gone = commands.where("command = 'delete'").select("id").distinct()
    last = commands.where("command = 'touch'").groupBy("id").agg(F.max_by("at", "seq").alias("__at"))
    left = watched.join(gone, "id", "left_anti").join(last, "id", "left")
    return left.withColumn("last_scanned_at", F.coalesce("__at", "last_scanned_at")).drop("__at")


def site_profiles(rows: DataFrame) -> DataFrame:
    """By domain: how often a profile was saved, its last container selector, its first title selector, its last time."""
    return rows.groupBy("domain").agg(
        F.count("*").alias("success_count"), F.max_by("container_selector", "seq").alias("container_selector"),
        F.min_by("title_selector", "seq").alias("title_selector"), F.max("saved_at").alias("last_updated"),
    )


def cache_upsert(existing: DataFrame | None, batch: DataFrame, refresh: bool = True) -> DataFrame:
    """Cached responses by URL, the last one in force; cached_at is the last time, or the first without refresh."""
    rows = batch if existing is None else batch.unionByName(existing.withColumn("seq", F.lit(-1).cast("long")))
    at = (F.max_by if refresh else F.min_by)("cached_at", "seq").alias("cached_at")
    return rows.groupBy("url").agg(F.max_by("etag", "seq").alias("etag"), F.max_by("size_bytes", "seq").alias("size_bytes"), at)


def cache_alive(cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return cache.where(F.col("cached_at") >= F.timestamp_add("DAY", F.lit(-days), now))


def housekeeping(cache: DataFrame, path: str, now: Column, days: int = 7, files: int = 1) -> DataFrame:
    """Write what is alive of a cache anew under a path, in so many files, and read it: old rows and small files go."""
    cache_alive(cache, now, days).repartition(files).write.mode("overwrite").parquet(path)
    return cache.sparkSession.read.parquet(path)


def cache_metrics(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def with_tags(resources: DataFrame, resource_tags: DataFrame) -> DataFrame:
    """Each resource with its tags, sorted and joined by bars; "" without any."""
    joined = resource_tags.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("name")), "|").alias("tag_names"))
    return resources.join(joined, "id", "left").withColumn("tag_names", F.coalesce("tag_names", F.lit("")))


def conform(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows with exactly the given columns: missing ones become null, unknown ones go."""
    return rows.select(*[(F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])
