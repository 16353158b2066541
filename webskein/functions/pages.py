"""Heuristics on raw pages and fetch outcomes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of pages that need scripts, words of firewalls, least length of a body, patterns of what is no text,
# of a page's body and of module scripts.
SPA_MARKS = ("__NEXT_DATA__", "data-reactroot", "__nuxt", "document.getElementById('root')", "react-root")
FIREWALLS = ("cloudflare", "akamai", "incapsula", "sucuri", "firewall")
LEAST_BODY = 1024
NO_TEXT, BODY, MODULE_SCRIPT = r"(?s)<script.*?</script>|<style.*?</style>|<.*?>", r"(?is)<body[^>]*>(.*?)</body>", r"""(?i)<script\s+type=["']?module["']?"""
CRITICAL_META = (r"""property=["']og:title["']""", r"""property=["']og:description["']""", r"""property=["']og:image["']""", r"""property=["']twitter:card["']""", r"""name=["']description["']""")


def needs_js(html: Column) -> Column:
    """Empty or short pages, those with a mark of a script application, and near-empty ones that ask for scripts."""
    low = F.lower(html)
    text = F.regexp_replace(F.regexp_replace(html, NO_TEXT, ""), r"^[\s]+|[\s]+$", "")
    marked = F.lit(False)
    for m in SPA_MARKS:
        marked = marked | html.contains(m)
    wall = (F.length(text) < 300) & low.contains("javascript") & (low.contains("enable") | low.contains("required"))
    return F.coalesce(html == "", F.lit(True)) | marked | wall | (F.length(html) < LEAST_BODY)


def render_reason(html: Column) -> Column:
    """spa_shell (render), static (do not) or no_indicator."""
    body = F.regexp_extract(html, BODY, 1)
    has_body = html.rlike(BODY)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.when(has_body, body).otherwise(html), "<[^>]+>", ""), r"\s+", " "))
    meta = sum((F.when(html.rlike("(?i)" + m), 1).otherwise(0) for m in CRITICAL_META), F.lit(0))
    return (
        F.when(html.isNull() | (html == ""), "no_indicator")
        .when(html.rlike(MODULE_SCRIPT), "spa_shell")
        .when((F.length(html) < 5000) & (F.length(text) < 100), "spa_shell")
        .when((F.length(html) >= 20000) & (meta >= 3), "static")
        .otherwise("no_indicator")
    )


def failure_class(error: Column, status: Column, body: Column) -> Column:
    """A failed fetch's class from the kind of error (connect_timeout, read_timeout, ssl, connection, http), status and body."""
    wall = F.lower(F.coalesce(body, F.lit(""))).rlike("|".join(FIREWALLS))
    return (
        F.when(error == "connect_timeout", "connection_timeout")
        .when(error == "read_timeout", "read_timeout")
        .when(error == "ssl", "ssl_error")
        .when(error == "connection", "dns_failed")
        .when((error == "http") & (status == 403), F.when(wall, "waf_blocked").otherwise("forbidden"))
        .when((error == "http") & status.isNotNull(), F.concat(F.lit("http_"), status))
        .otherwise("fetch_failed")
    )
