"""The crawl as a frontier over a table of pages: one DataFrame step a level of depth.

Admission order is depth, then the place of the parent, then the place of the link, so it
does not depend on the number of workers. Page budgets hold for each platform; since a job's
budget is that of all its platforms together, no global ordering is needed. Each level is
written to the shared folder before the next, so its plan stays small and a lost executor costs one level at most.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import urls
from textloom.operators.dedup import first_of_each
from textloom.operators.html import page_links, with_parsed
from textloom.operators.records import build_records
from textloom.plans import lexicon as lx
from textloom.plans.lexicon import DEFAULT, Lexicon
from textloom.plans.storage import exists, materialise, new_path, release
from textloom.plans.storage import remove as release_path


@dataclass(frozen=True)
class CrawlConfig:
    """max_pages: of each platform; limits as in the job model. None: no budget, for a table of pages, which has an end of its own."""

    start_urls: tuple[str, ...]
    max_pages: int | None = 250
    max_depth: int = 2
    concurrency: int = 2
    include_sitemap: bool = True
    lexicon: Lexicon = field(default=DEFAULT)

    def __post_init__(self):
        if not self.start_urls:
            raise ValueError("a crawl needs a start URL")
        if self.max_pages is not None and not 1 <= self.max_pages <= 25_000 or not 0 <= self.max_depth <= 8 or self.concurrency < 1:
            raise ValueError("max_pages is 1 to 25000, max_depth 0 to 8, concurrency 1 or more")

    @classmethod
    def requested(cls, start_urls: tuple[str, ...], concurrency: int = 2, **more) -> CrawlConfig:
        """A configuration as a caller may ask for it: 1 to 6 workers, and a budget."""
        if not 1 <= concurrency <= 6:
            raise ValueError("concurrency is 1 to 6")
        if more.get("max_pages", 1) is None:
            raise ValueError("a request has a budget of pages")
        return cls(start_urls, concurrency=concurrency, **more)

    @property
    def total_pages(self) -> int:
        """0 where there is no budget."""
        return (self.max_pages or 0) * len(self.start_urls)

    @property
    def workers(self) -> int:
        return max(1, min(self.concurrency, lx.WORKERS_PER_PLATFORM * len(self.start_urls)))


def worker_quota(platforms: DataFrame, key: str, order: str, total: Column | int) -> DataFrame:
    """Workers of each platform: an even share, one more for the first of the rest, 3 at most; 1 each if there are fewer workers than platforms."""
    total = F.greatest(F.lit(1), total if isinstance(total, Column) else F.lit(total))
    every = platforms.select(F.count("*").alias("__n"))
    nth = F.row_number().over(Window.orderBy(order))
    rows = platforms.select(key, order).withColumn("__i", nth - 1).crossJoin(F.broadcast(every))
    share = F.floor(total / F.col("__n"))
    limit = F.when(share == 0, 1).otherwise(F.least(F.lit(lx.WORKERS_PER_PLATFORM), share + F.when(F.col("__i") < total % F.col("__n"), 1).otherwise(0)))
    return rows.select(key, limit.cast("int").alias("workers"))


def seeds(spark: SparkSession, config: CrawlConfig) -> DataFrame:
    """A row per distinct normalised start URL, in order: url, platform_id, root_host, seq."""
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(config.start_urls)], "seq long, given string")
    rows = rows.withColumn("url", urls.normalize(F.col("given"))).filter("url is not null")
    first = first_of_each(rows, ["url"], ["seq"])
    return first.select("url", F.col("url").alias("platform_id"), urls.root_host(F.col("url")).alias("root_host"), "seq")


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds nth, the place within a key from 1, with no key in one task: rows are dealt by ranges of key and order, numbered within a range, and each range begins where those before it end."""
    dealt = materialise(rows.repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = dealt.groupBy(key, "__range").agg(F.count("*").alias("__n")).select(key, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*order))
    return dealt.withColumn("__within", within).join(F.broadcast(begins), [key, "__range"]).select(
        *rows.columns, (F.col("__before") + F.col("__within")).cast("int").alias("nth")
    )


def admit(candidates: DataFrame, visited: DataFrame | None, depth: int, max_pages: int | None, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Candidates (url, platform_id, root_host, seq) that enter the frontier: new, of the site, a page, relevant below the seeds, within the platform's budget."""
    ok = urls.same_site(F.col("url"), F.col("root_host")) & urls.is_page(F.col("url"))
    if depth:
        ok = ok & urls.relevant(F.col("url"), lexicon)
    rows = first_of_each(candidates.filter(ok), ["url"], ["seq", "platform_id"])
    nth = F.row_number().over(Window.partitionBy("platform_id").orderBy("seq", "url"))
    if max_pages is None:
        new = rows if visited is None else rows.join(visited.select("url"), "url", "left_anti")
        return numbered(new, "platform_id", ["seq", "url"]).withColumn("depth", F.lit(depth))
    if visited is None:
        return rows.withColumn("nth", nth).filter(F.col("nth") <= max_pages).withColumn("depth", F.lit(depth))
    used = visited.groupBy("platform_id").agg(F.count("*").alias("used"))
    left = rows.join(visited.select("url"), "url", "left_anti").withColumn("nth", nth).filter(F.col("nth") <= max_pages)
    within = left.join(used, "platform_id", "left").filter(F.col("nth") <= max_pages - F.coalesce("used", F.lit(0)))
    return within.drop("used").withColumn("depth", F.lit(depth))


def frontier(spark: SparkSession, links: DataFrame, start: DataFrame, config: CrawlConfig) -> DataFrame:
    """All admitted URLs with depth, breadth first. links: src, pos, url; start: url, platform_id, root_host, seq."""
    level = materialise(admit(start, None, 0, config.max_pages, config.lexicon), "frontier")
    every = level
    for depth in range(1, config.max_depth + 1):
        parents = level.select(F.col("url").alias("src"), "platform_id", "root_host", F.col("nth").alias("parent"))
        reached = links.join(parents, "src").withColumn("seq", F.struct("parent", "pos"))
        level = materialise(
            admit(reached.select("url", "platform_id", "root_host", "seq"), every, depth, config.max_pages, config.lexicon).withColumn("seq", F.col("nth").cast("long")),
            "frontier"
        )
        every = every.unionByName(level)
        if level.isEmpty():
            break
    return every


@dataclass
class Crawl:
    """visited: url, platform_id, root_host, seq, nth, depth; records: accepted and rejected pages; progress: a row per platform; errors.

    state: completed, paused or cancelled; of a cancelled crawl nothing is left."""

    visited: DataFrame
    records: DataFrame
    progress: DataFrame
    errors: DataFrame
    state: str = "completed"


#: Adds html and failed (why there is none) to the URLs of a level: url, platform_id, root_host, seq, nth, workers.
PageSource = Callable[[DataFrame], DataFrame]
LEVELS = "depth int, settings string, discovered long, failed long, accepted long, rejected long"


class CrawlLog:
    """What a crawl has done, in a folder of its own.

    pages/depth=d is a level; levels/depth=d, one row written after it, says that it is whole, with its counts. A level without that
    row is written anew. control is what the crawl has been asked to do, which it reads between levels."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def levels(self) -> list[dict]:
        """The rows of the levels that are whole, in order."""
        if not exists(self.spark, f"{self.path}/levels"):
            return []
        return [r.asDict() for r in self.spark.read.schema(LEVELS).json(f"{self.path}/levels").orderBy("depth").collect()]

    def write(self, depth: int, rows: DataFrame, settings: str) -> dict:
        """Write a level, counted as it is written, then say that it is whole."""
        seen = Observation()
        count = lambda what, name: F.count_if(what).alias(name)
        failed, fine = F.col("error").isNotNull(), F.col("reject_reason").isNull()
        rows.observe(
            seen, F.count(F.lit(1)).alias("discovered"), count(failed, "failed"), count(~failed & fine, "accepted"), count(~failed & ~fine, "rejected")
        ).write.mode("overwrite").parquet(f"{self.path}/pages/depth={depth}")
        row = {"depth": depth, "settings": settings, **seen.get}
        self.spark.createDataFrame([row], LEVELS).drop("depth").coalesce(1).write.mode("overwrite").json(f"{self.path}/levels/depth={depth}")
        return row

    def pages(self, most: int, least: int = 0) -> DataFrame:
        """The rows of these levels, with depth."""
        frames = [self.spark.read.parquet(f"{self.path}/pages/depth={d}").withColumn("depth", F.lit(d)) for d in range(least, most + 1)]
        return functools.reduce(DataFrame.unionByName, frames)

    def ask(self, what: str) -> None:
        self.spark.createDataFrame([(what,)], "asked string").coalesce(1).write.mode("overwrite").json(f"{self.path}/control")

    def asked(self) -> str:
        if not exists(self.spark, f"{self.path}/control"):
            return "run"
        row = self.spark.read.schema("asked string").json(f"{self.path}/control").first()
        return row.asked if row else "run"


def pause(spark: SparkSession, path: str) -> None:
    """The crawl in that folder stops after the level at hand; run_crawl with the same folder goes on."""
    CrawlLog(spark, path).ask("pause")


def cancel(spark: SparkSession, path: str) -> None:
    """The crawl in that folder stops after the level at hand, and its log is removed."""
    CrawlLog(spark, path).ask("cancel")


def stored_pages(pages: DataFrame) -> PageSource:
    """A table of pages (url, html) as a crawl's source; of rows with one URL, by any spelling, the first by html counts."""
    known = first_of_each(pages.withColumn("url", urls.normalize(F.col("url"))).filter("url is not null"), ["url"], ["html"]).select("url", "html")
    return lambda level: level.join(known, "url", "left").withColumn("failed", F.when(F.col("html").isNull(), "no page"))


def _start(spark: SparkSession, config: CrawlConfig, sitemap_urls: DataFrame | Callable[[], DataFrame] | None) -> DataFrame:
    start = seeds(spark, config)
    if config.include_sitemap and sitemap_urls is not None:
        found = sitemap_urls() if callable(sitemap_urls) else sitemap_urls
        more = found.join(start.select("platform_id", "root_host"), "root_host").select(
            urls.canonical(F.col("url")).alias("url"), "platform_id", "root_host", (F.col("seq") + len(config.start_urls)).alias("seq")
        )
        start = start.unionByName(more)
    return start


def run_crawl(
    spark: SparkSession, pages: DataFrame | PageSource, config: CrawlConfig, sitemap_urls: DataFrame | Callable[[], DataFrame] | None = None,
    path: str | None = None, told: Callable[[dict], None] | None = None
) -> Crawl:
    """Crawl by levels: the URLs that a level admits are fetched from `pages`, parsed, judged and written, and their links make the next level.

    pages: a table (url, html), or what fetches a level, such as web.live_pages(). A URL without a page, or with one that the parser rejects, is a failed fetch.
    sitemap_urls: url, root_host, seq, entering at depth 0 after the seeds; a function is called only if depth 0 is still to be done.
    path: the crawl's log; run_crawl with the same path goes on after its last whole level, with the rows of a crawl that was not stopped. Without it a folder that goes when the process ends.
    told: gets the counts of each level as it is done; they come from the write, not from another pass."""
    log = CrawlLog(spark, path or new_path(spark, "crawl"))
    source = stored_pages(pages) if isinstance(pages, DataFrame) else pages
    settings = hashlib.sha256(repr(config).encode()).hexdigest()
    if log.asked() == "pause":
        log.ask("run")
    done = log.levels()
    if any(row["settings"] != settings for row in done):
        raise ValueError("the crawl in this folder has other settings")
    quota = worker_quota(seeds(spark, config), "platform_id", "seq", config.workers)
    state = "completed"
    for depth in range(len(done), config.max_depth + 1):
        if done and not done[-1]["discovered"]:
            break
        if (asked := log.asked()) != "run":
            state = {"pause": "paused", "cancel": "cancelled"}[asked]
            break
        if depth:
            level = log.pages(depth - 1, depth - 1)
            parents = level.select(F.col("url").alias("src"), "platform_id", "root_host", F.col("nth").alias("parent"), "hrefs")
            reached = page_links(parents, F.col("src")).select("url", "platform_id", "root_host", F.struct("parent", "pos").alias("seq"))
            new = admit(reached, log.pages(depth - 1).select("url", "platform_id"), depth, config.max_pages, config.lexicon).withColumn("seq", F.col("nth").cast("long"))
        else:
            new = admit(_start(spark, config, sitemap_urls), None, 0, config.max_pages, config.lexicon)
        wanted = new.drop("depth").join(F.broadcast(quota), "platform_id", "left").select("url", "platform_id", "root_host", "seq", "nth", "workers")
        # the admitted URLs are fixed before the first of them is fetched: a task that is run again fetches the same
        wanted = materialise(wanted, "frontier")
        parsed = with_parsed(source(wanted)).withColumn("error", F.coalesce("failed", "error")).withColumn("source_url", F.col("url")).drop("failed", "workers")
        empty = F.array().cast("array<string>")
        whole = parsed.withColumns({c: F.when(F.col("error").isNull(), F.col(c)).otherwise(empty) for c in ("blocks", "hrefs")})
        done.append(log.write(depth, build_records(whole, config.lexicon, even=True), settings))
        release(wanted)
        if told:
            told(done[-1])
    if state == "cancelled":
        release_path(spark, log.path)
        nothing = spark.createDataFrame([], "url string, platform_id string, root_host string, seq long, nth int, depth int")
        return Crawl(nothing, nothing, nothing, nothing, state)
    if not done:
        raise ValueError("the crawl was asked to stop before its first level")
    every = log.pages(len(done) - 1)
    visited = every.select("url", "platform_id", "root_host", "seq", "nth", "depth")
    failed = every.filter("error is not null").select("url", "platform_id", F.concat("url", F.lit(": "), "error").alias("error"))
    records = every.filter("error is null").drop("error", "hrefs")
    return Crawl(visited, records, progress(visited, records, failed), failed, state)


def progress(visited: DataFrame, records: DataFrame, failed: DataFrame) -> DataFrame:
    """Counters and status of each platform. A failed page counts as scraped, neither accepted nor rejected."""
    marks = visited.select("platform_id", F.lit("discovered").alias("what")).union(records.select(
        "platform_id", F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected")
    )).union(failed.select("platform_id", F.lit("failed")))
    count = lambda what: F.count_if(F.col("what") == what)
    out = marks.groupBy("platform_id").agg(
        count("discovered").alias("discovered"), (count("accepted") + count("rejected") + count("failed")).alias("scraped"),
        count("accepted").alias("accepted"), count("rejected").alias("rejected"), count("failed").alias("failed")
    )
    return out.withColumn("status", F.when(F.col("accepted") == 0, "empty").otherwise("completed")).withColumn(
        "message",
        F.when(F.col("accepted") > 0, "Completed.").when(F.col("discovered") == 0, "No pages found.").otherwise("No accepted medical pages.")
    )


def completion_message(accepted: Column, failed: Column, rate_limited: Column) -> Column:
    return F.when(accepted > 0, F.lit(None)).when(rate_limited, lx.RATE_LIMITED).when(failed > 0, lx.NOT_FETCHED).otherwise(lx.NONE_PASSED)


def error_tail(errors: DataFrame, order: str, keep: int = 100, shown: int = 20) -> DataFrame:
    """The last `shown` of the last `keep` errors, oldest first. A report: the limit is the feature."""
    last = errors.orderBy(F.desc(order)).limit(min(keep, shown))
    return last.orderBy(order)
