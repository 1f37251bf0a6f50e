"""robots.txt and sitemaps, stored as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import urls
from textloom.functions.text import strip_ws
from textloom.operators.dedup import first_of_each
from textloom.plans.lexicon import DEFAULT, Lexicon
from textloom.plans.storage import materialise

MAX_SITEMAPS = 201
_LOC = r"(?s)<(?:[\w.-]+:)?loc(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?loc\s*>"
_ROOT = r"(?s)\A(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<(?:[\w.-]+:)?([\w.-]+)"


def robots_sitemaps(text: Column) -> Column:
    """What stands after the first colon of lines that begin with sitemap:, in order."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r]", -1), lambda x: F.startswith(F.lower(x), F.lit("sitemap:")))
    return F.filter(F.transform(lines, lambda x: strip_ws(F.substring(x, 9, 1 << 30))), lambda x: x != "")


def _replaced(values: Column, old: str, new: str) -> Column:
    return F.transform(values, lambda x: F.replace(x, F.lit(old), F.lit(new)))


def _locations(xml: Column) -> Column:
    found = F.transform(F.regexp_extract_all(xml, F.lit(_LOC), F.lit(1)), strip_ws)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        found = _replaced(found, entity, char)
    return F.filter(found, lambda x: x != "")


def _balanced(xml: Column) -> Column:
    """As many tags that open as close. from_xml alone takes a document that breaks off."""
    bare = F.regexp_replace(xml, r"(?s)<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>", "")
    return F.regexp_count(bare, F.lit(r"<[A-Za-z_](?:[^>]*[^/>])?>")) == F.regexp_count(bare, F.lit(r"</[A-Za-z_]"))


def parse_sitemap(xml: Column) -> Column:
    """struct(urls, nested): every loc of a urlset, or of a sitemapindex; both empty for other roots and for XML that is not well-formed."""
    well = F.from_xml(xml, "url ARRAY<STRUCT<loc:STRING>>").isNotNull() & _balanced(xml)
    root = F.regexp_extract(xml, _ROOT, 1)
    none = F.array().cast("array<string>")
    pick = lambda name: F.when(well & (root == name), _locations(xml)).otherwise(none)
    return F.struct(pick("urlset").alias("urls"), pick("sitemapindex").alias("nested"))


def expand_sitemaps(files: DataFrame | Callable[[DataFrame], DataFrame], start: DataFrame, max_urls: int, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """URLs that sitemaps reach: root_host, url, seq. files: url, xml, or what adds xml to a table with url; start: url, root_host, nth.

    A sitemap's own URLs come before those of the ones it names, each sitemap once for a site, 201 sitemaps of a
    site at most, so at most 201 levels, as a sitemap comes after all that lead to it; URLs of the site only, pages only, relevant only; the first of each, max_urls of a site."""
    split = lambda rows: rows.withColumn("p", parse_sitemap(F.col("xml"))).select("url", "p.urls", "p.nested")
    parsed = split(files) if isinstance(files, DataFrame) else None
    level = start.select("root_host", "url", F.array(F.col("nth").cast("int")).alias("way"))
    seen = None
    for _ in range(MAX_SITEMAPS):
        level = first_of_each(level, ["root_host", "url"], ["way"])
        level = materialise(level if seen is None else level.join(seen, ["root_host", "url"], "left_anti"), "sitemaps")
        if level.isEmpty():
            break
        seen = level if seen is None else seen.unionByName(level)
        if not isinstance(files, DataFrame):
            new = level.select("url").distinct()
            new = materialise(split(files(new if parsed is None else new.join(parsed, "url", "left_anti"))), "fetched")
            parsed = new if parsed is None else parsed.unionByName(new)
        level = level.join(parsed, "url").select("root_host", "way", F.posexplode("nested").alias("pos", "url")).select(
            "root_host", "url", F.concat("way", F.array(F.col("pos") + 1)).alias("way")
        )
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("root_host").orderBy("way"))
    used = seen.withColumn("k", nth).filter(F.col("k") <= MAX_SITEMAPS)
    rows = used.join(parsed, "url").select("root_host", "way", F.posexplode("urls").alias("pos", "url")).withColumn("way", F.concat("way", F.array(F.lit(0), F.col("pos"))))
    ok = urls.same_site(F.col("url"), F.col("root_host")) & urls.is_page(F.col("url")) & urls.relevant(F.col("url"), lexicon)
    first = first_of_each(rows.filter(ok), ["root_host", "url"], ["way"])
    return first.withColumn("seq", nth).filter(F.col("seq") <= max_urls).select("root_host", "url", F.col("seq").cast("long"))


def discovery_order(robots: DataFrame) -> DataFrame:
    """Where to look for a site's sitemaps: /sitemap.xml, then robots entries. robots: url (of a page of the site), text."""
    site = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.netloc(F.col("url")))
    every = F.concat(F.array(F.concat(site, F.lit("/sitemap.xml"))), F.coalesce(robots_sitemaps(F.col("text")), F.array().cast("array<string>")))
    rows = robots.select(urls.root_host(F.col("url")).alias("root_host"), F.posexplode(every).alias("nth", "url"))
    return first_of_each(rows, ["root_host", "url"], ["nth"])
