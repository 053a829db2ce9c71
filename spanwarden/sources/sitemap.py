"""Addresses of a site from its sitemaps, which lie in a table of fetched bodies (url, content).

Nothing is fetched here: a job with network access fills the table. Sitemaps may name others, a few levels
deep; each level is one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwarden.operators import files
from spanwarden.plans.shipping import ship

#: Levels of sitemaps that name sitemaps, and addresses that one collection returns.
DEPTH, MOST = 3, 200
#: Where a site's sitemaps are looked for, after its robots file's own line.
PLACES = ("/sitemap.xml", "/sitemap_index.xml")


def starts(bodies: DataFrame, site: str, sitemap: str | None = None) -> DataFrame:
    """(url): the sitemap that is named, else the first of the usual places that was fetched, else those of robots.txt."""
    site = site.rstrip("/")
    if sitemap:
        return bodies.select(F.lit(sitemap).alias("url")).limit(1)
    there = [p for p in PLACES if not bodies.filter(F.col("url") == site + p).isEmpty()]
    if there:
        return bodies.filter(F.col("url") == site + there[0]).select("url").distinct()
    robots = bodies.filter(F.col("url") == site + "/robots.txt").select(F.explode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("line"))
    return robots.select(F.regexp_extract("line", r"(?i)^\s*sitemap:\s*(\S+)", 1).alias("url")).filter("url <> ''").distinct()


def collected(bodies: DataFrame, site: str, sitemap: str | None = None, most: int = MOST) -> DataFrame:
    """(url, level): the pages that the site's sitemaps name, ``most`` at most; one of another origin is an error."""
    ship(bodies.sparkSession)
    allowed = files.origin_allowed(files.origin(F.col("loc")), files.origin(F.lit(site)))
    level, seen, pages = starts(bodies, site, sitemap), None, None
    for depth in range(DEPTH + 1):
        text = F.decode(files.gunzipped(F.col("content")), "UTF-8")
        maps = bodies.join(level, "url", "left_semi").select(text.alias("text")).filter("text is not null")
        named = maps.select(F.col("text").rlike(r"(?s)<(?:\w+:)?sitemapindex[\s>]").alias("index"), F.explode(files.sitemap_locations(F.col("text"))).alias("loc")).filter("loc <> ''").distinct()
        if strange := named.filter(~allowed).first():
            raise ValueError(f"a sitemap of {site} names {strange['loc']}")
        own = named.filter("not index").select(F.col("loc").alias("url"), F.lit(depth).alias("level"))
        pages = own if pages is None else pages.unionByName(own)
        seen = level if seen is None else seen.union(level)
        level = named.filter("index").select(F.col("loc").alias("url")).join(seen, "url", "left_anti")
        if level.isEmpty():
            break
    return pages.groupBy("url").agg(F.min("level").alias("level")).orderBy("level", "url").limit(most)
