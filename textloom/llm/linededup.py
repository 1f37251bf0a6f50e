"""Line dedup by site-relative frequency (4), in DataFrame functions only.

The documents are grouped by host. A line's page count is the number of that host's
documents that hold it, white space around it apart; divided by the host's documents it
gives the line's ratio. Lines over `max_ratio` that are on two documents of their host or more are
boilerplate there and are dropped from every document of the host. A line on one document is not
repeated, whatever its ratio on a host of few. `min_pages` and `min_line_pages` can ask for more
documents of a host and of a line; by default they leave no host out.

The boilerplate lines of one host fit in an array: each is in over max_ratio of the
host's documents, so there are at most (mean lines a document) / max_ratio of them.
Counting is combined before the shuffle and the key holds the line, so a host with a
third of all documents is spread over all tasks. The table of boilerplate is broadcast only
if its measured size is under `broadcast_bytes`; else it is joined with salted hosts.

Defined results for odd input: null text is kept as null with no lines dropped; null
host is a host of its own; lines without a word never count; documents that repeat count
each; an empty table gives an empty result; columns other than those named are kept, whatever their names,
but for lines_total and lines_dropped, which `site_line_dedup` replaces and `cut_documents` keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, named, private

#: White space around a line that does not count.
EDGE = " \t\x0b\x0c\r"
NO_HOST = "\x00none"


def host_of(column: Column) -> Column:
    """The host of a URL, lower-cased and without port; a name that is not a URL is its own host."""
    found = F.regexp_extract(F.lower(column), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.when(found != "", found).otherwise(column), F.lit(NO_HOST))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(EDGE)))


def boilerplate_lines(docs: DataFrame, host: str, text: str, max_ratio: float, min_pages: int, min_line_pages: int) -> DataFrame:
    """host, lines: array of the keys of lines over the ratio."""
    pages = docs.select(host_of(named(host)).alias("host"), named(text).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(EDGE)) != ""), _key))
    counts = pages.filter(F.col("text").isNotNull()).select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_line_pages)
    over = counts.join(totals, "host").filter(F.col("n") > max_ratio * F.col("pages"))
    return over.groupBy("host").agg(F.collect_list("line").alias("lines"))


def site_line_dedup(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 1,
    min_line_pages: int = 2, broadcast_bytes: int = 16 << 20
) -> DataFrame:
    """docs with `text` cut, and lines_total, lines_dropped (long) added, in place of columns of those names."""
    found = materialise(boilerplate_lines(docs, host, text, max_ratio, min_pages, min_line_pages), "boilerplate")
    size = found.agg(F.sum(16 + 8 * F.size("lines"))).first()[0] or 0
    key, of, lines_key, salt, at = private(docs, "__key", "__host", "__lines", "__salt", "__of")
    side = found.select(F.col("host").alias(of), F.col("lines").alias(lines_key))
    rows = docs.withColumn(key, host_of(named(host)))
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(side), F.col(key) == F.col(of), "left")
    else:
        salts = 64
        salted = side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn(at, F.pmod(F.xxhash64(named(text)), F.lit(salts)).cast("int"))
        joined = rows.join(salted, (F.col(key) == F.col(of)) & (F.col(at) == F.col(salt)), "left")
    lines, none = _lines(named(text)), F.lit(0).cast("long")
    stay = F.filter(lines, lambda x: ~F.array_contains(F.col(lines_key), _key(x)))
    whole = F.col(lines_key).isNull() | named(text).isNull()
    cut = F.when(whole, named(text)).otherwise(F.array_join(stay, "\n"))
    total = F.when(named(text).isNull(), none).otherwise(F.size(lines).cast("long"))
    dropped = F.when(whole, none).otherwise(total - F.size(stay))
    kept = [cut.alias(c) if c == text else named(c) for c in docs.columns if c.lower() not in ("lines_total", "lines_dropped")]
    return joined.select(*kept, total.alias("lines_total"), dropped.alias("lines_dropped"))


def cut_documents(docs: DataFrame, **options) -> DataFrame:
    """docs without their hosts' boilerplate lines; same columns, n_chars counted anew."""
    mine = private(docs, "__text")[0]  # beside the columns, so that those that site_line_dedup names stay
    aside = {c: n for c, n in zip(docs.columns, private(docs, *(f"__own_{c}" for c in docs.columns)), strict=True) if c.lower() in ("lines_total", "lines_dropped")}
    cut = site_line_dedup(docs.withColumnsRenamed(aside), **options).withColumn(mine, F.col(options.get("text", "text")))
    return cut.select(*(F.length(mine).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else named(aside.get(c, c)).alias(c) for c in docs.columns))
