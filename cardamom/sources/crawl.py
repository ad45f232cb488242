"""What surrounds a crawl, as tables: sitemaps, robots rules, the page cache, and polite schedules.

Fetching itself is a connector's business; these operators decide what to fetch, and when.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import numbered
from ..session import stored
from .robots import permitted

DEPTH = 4
#: What a sitemap and a sitemap index say, by the names of their elements in any namespace.
SITEMAP = "sitemap array<struct<loc: string>>, url array<struct<loc: string>>"


def _trimmed(entries: Column) -> Column:
    locs = F.transform(F.coalesce(entries, F.array().cast("array<struct<loc: string>>")), lambda e: F.regexp_replace(e["loc"], r"^[\s\x{FEFF}\x{A0}]+|[\s\x{FEFF}\x{A0}]+$", ""))
    return F.filter(locs, lambda x: x.isNotNull() & (x != ""))


def sitemap_urls(maps: DataFrame, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(url): the pages of all sitemaps below the roots. maps has (url, xml); an index leads on, `depth` levels at most.

    XML is read by its structure: entries in comments don't count, CDATA, references and namespaces do. Broken XML has no
    entries. Each round follows the maps that the round before it found and no round has seen, so indexes that lead to
    each other come to an end, and each map is read once.
    """
    spark = maps.sparkSession
    read = F.from_xml("xml", SITEMAP, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    parsed = stored(maps.select("url", read.alias("r")).select("url", _trimmed(F.col("r.sitemap")).alias("maps"), _trimmed(F.col("r.url")).alias("pages")), "maps")
    front = stored(roots.select("url").distinct(), "front")
    seen, pages = front, spark.createDataFrame([], "url string")
    for level in range(depth + 1):
        met = parsed.join(front, "url", "left_semi")
        pages = pages.unionAll(met.select(F.explode("pages").alias("url")))
        if level == depth:
            break
        front = stored(met.select(F.explode("maps").alias("url")).distinct().join(seen, "url", "left_anti"), "front")
        if not front.limit(1).count():
            break
        seen = seen.unionAll(front)
    return pages.distinct()


def cached(requests: DataFrame, cache: DataFrame, now: Column, days: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """requests with cache_key = sha1(url) and hit: a page of status 200 that is not older than `days` days.

    With `by`, columns of both, what one request has kept of a URL serves no other request of that URL.
    """
    fresh = cache.where((F.col("status") == 200) & (F.col("fetched_at") >= now - F.make_dt_interval(F.lit(days)))).select("cache_key", *by).distinct().withColumn("__hit", F.lit(True))
    keyed = requests.withColumn("cache_key", F.sha1(F.col("url").cast("binary")))
    return keyed.join(fresh, ["cache_key", *by], "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def allowed(requests: DataFrame, robots: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """requests with `allowed`, by the longest robots rule (host, prefix, allow) that the path begins with; of equals the allowing one."""
    return permitted(requests, robots.select(F.col(host).alias("host"), F.col("prefix").alias("pattern"), "allow"), host, path)


def schedule(requests: DataFrame, host: str, order: str, delays: DataFrame | None = None, seconds: float = 2.0) -> DataFrame:
    """requests with start, in seconds: those of one host in their order, its delay apart (`seconds` at least)."""
    if delays is not None:
        requests = requests.join(delays.select(host, "delay"), host, "left")
        delay = F.greatest(F.coalesce("delay", F.lit(seconds)), F.lit(seconds))
    else:
        delay = F.lit(seconds)
    at = numbered(requests, host, F.lit(-1), [order])
    return at.withColumn("start", F.col("number") * delay).drop("number")
