"""Live pages as a Python data source: spark.read.format("web_pages").option("urls", ...).load().

Each URL is fetched by one task: three attempts, waits of one to five seconds as the server asks, redirects
followed, HTML only. A page that cannot be fetched is a row with an error, whatever the server sent. Pages that robots.txt disallows are not fetched.
`fetch_pages` does the same for a table of URLs, with a bound on the requests to a host at once; a crawl fetches its levels by it.
"""

from __future__ import annotations

import http.client
import re
import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Callable
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.functions import urls
from textloom.operators.crawl import Crawl, CrawlConfig, run_crawl
from textloom.operators.html import with_parsed
from textloom.operators.sitemap import discovery_order, expand_sitemaps
from textloom.plans.storage import materialise

AGENT = "textloom/1.0"
RETRIED = frozenset((429, 500, 502, 503, 504))
MAX_BYTES = 20 << 20  # of a page; a longer one is an error row
_FAILS = (OSError, ValueError, http.client.HTTPException)  # what a server can make of a request: no reply, a broken one, a broken address
Fetched = tuple[str | None, str | None]


def _decoded(got, limit: int) -> str | None:
    """The body by the charset it claims, UTF-8 where that is unknown; None where it is longer than the limit."""
    body = got.read(limit + 1)
    if len(body) > limit:
        return None
    if (length := got.headers.get("content-length", "")).isdigit() and len(body) < int(length):
        raise http.client.IncompleteRead(body, int(length) - len(body))
    charset = got.headers.get_content_charset() or "utf-8"
    try:
        return body.decode(charset, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _open(url: str, timeout: float, **headers: str):
    return urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT, **headers}), timeout=timeout)


def fetch(url: str, timeout: float = 20.0, attempts: int = 3, sleep=time.sleep, max_bytes: int = MAX_BYTES) -> Fetched:
    """The page's HTML, or why there is none. Whatever a server sends, or does not, is this page's error."""
    for attempt in range(1, attempts + 1):
        try:
            with _open(url, timeout, Accept="text/html") as got:
                kind = got.headers.get("content-type", "")
                if "text/html" not in kind and "application/xhtml" not in kind:
                    return None, "the URL did not return an HTML page"
                html = _decoded(got, max_bytes)
                return (html, None) if html is not None else (None, f"the page is over {max_bytes} bytes")
        except urllib.error.HTTPError as e:
            asked = (e.headers.get("retry-after") or "").strip()
            wait = max(int(asked), 0) if re.fullmatch(r"[+-]?[0-9]{1,9}", asked) else None
            if e.code == 429 and wait and wait > 20:
                return None, f"rate-limited (HTTP 429), retry after about {wait} seconds"
            if e.code not in RETRIED or attempt == attempts:
                return None, f"HTTP {e.code}"
            sleep(min(max(attempt if wait is None else wait, 1), 5))
        except _FAILS as e:
            if attempt == attempts:
                return None, f"{type(e).__name__}: {e}"[:300]
            sleep(min(attempt, 3))
    return None, "no attempt"


def fetch_text(url: str, timeout: float = 8.0, max_bytes: int = MAX_BYTES) -> str | None:
    """A plain text at once or not at all: robots.txt and sitemaps. The timeout is 3 seconds at least."""
    try:
        with _open(url, max(3.0, timeout)) as got:
            return _decoded(got, max_bytes)
    except _FAILS:
        return None


def robots_rules(site: str, timeout: float = 8.0) -> urllib.robotparser.RobotFileParser:
    """What robots.txt of a site allows: nothing where reading it is forbidden, everything where it can't be read."""
    rules = urllib.robotparser.RobotFileParser()
    try:
        with _open(f"{site}/robots.txt", max(3.0, timeout)) as got:
            rules.parse((_decoded(got, MAX_BYTES) or "").splitlines())
    except urllib.error.HTTPError as e:
        rules.disallow_all, rules.allow_all = e.code in (401, 403), e.code not in (401, 403)
    except _FAILS:
        rules.allow_all = True
    return rules


class Visitor:
    """Fetches the URLs of a task one after the other: robots.txt once a site, `delay` seconds between two requests to a host,
    and no request to a host that has said to wait until it may be asked again."""

    def __init__(self, fetch: Callable[[str], Fetched] = fetch, delay: float = 0.0, robots: Callable[[str], urllib.robotparser.RobotFileParser] | None = robots_rules, clock=time.monotonic, sleep=time.sleep):
        self.fetch, self.delay, self.robots, self.clock, self.sleep = fetch, delay, robots, clock, sleep
        self.rules: dict[str, urllib.robotparser.RobotFileParser] = {}
        self.last: dict[str, float] = {}
        self.until: dict[str, float] = {}

    def visit(self, url: str) -> Fetched:
        try:
            parts = urlsplit(url)
        except ValueError as e:
            return None, f"ValueError: {e}"
        site, host = f"{parts.scheme}://{parts.netloc}", parts.netloc
        if self.robots:
            if site not in self.rules:
                self.rules[site] = self.robots(site)
            if not self.rules[site].can_fetch(AGENT, url):
                return None, "disallowed by robots.txt"
        if self.clock() < self.until.get(host, 0.0):
            return None, "rate-limited (HTTP 429), the host asked to wait"
        if (wait := self.last.get(host, -self.delay) + self.delay - self.clock()) > 0:
            self.sleep(wait)
        html, error = self.fetch(url)
        self.last[host] = self.clock()
        if error and (asked := re.match(r"rate-limited .* (\d+) seconds", error)):
            self.until[host] = self.clock() + int(asked[1])
        return html, error


def fetch_pages(rows: DataFrame, fetch: Callable[[str], Fetched] = fetch, delay: float = 0.0, tasks: int = 64, robots=robots_rules) -> DataFrame:
    """rows (url, workers, ...) with html and failed, fetched by the tasks.

    A host's URLs are dealt to `workers` slots by a hash of the URL, and a slot's are in one task, which asks for them one by one: so
    no host is asked by more than `workers` tasks at once, however many URLs it has. `tasks` bounds the requests at once over all hosts."""
    host, slot = urls.netloc(F.col("url")), F.pmod(F.xxhash64("url"), F.greatest(F.col("workers"), F.lit(1)))
    dealt = rows.withColumn("__host", F.lower(host)).withColumn("__slot", slot).repartition(tasks, "__host", "__slot").sortWithinPartitions("__host", "__slot", "url").drop("__host", "__slot")
    at = rows.columns.index("url")

    def run(batches):
        visitor, held, size = Visitor(fetch, delay, robots), [], 0
        for batch in batches:
            done = 0
            for i, url in enumerate(batch.column(at).to_pylist()):
                held.append(visitor.visit(url))
                size += len(held[-1][0] or "")
                if size >= 1 << 20 or i + 1 == batch.num_rows:
                    part = batch.slice(done, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([h[k] for h in held], pa.string()) for k in (0, 1))], [*batch.schema.names, "html", "failed"])
                    done, held, size = i + 1, [], 0

    fields = [*rows.schema.fields, T.StructField("html", T.StringType()), T.StructField("failed", T.StringType())]
    return dealt.mapInArrow(run, T.StructType(fields))


def with_texts(rows: DataFrame, url: str = "url", text: str = "text", timeout: float = 8.0) -> DataFrame:
    """rows with the text at each URL, null where there is none; fetched by the tasks."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(url)
            found = pa.array([x and fetch_text(x, timeout) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, text])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))


def discover(spark: SparkSession, start_urls: list[str], max_urls: int, timeout: float = 8.0) -> DataFrame:
    """root_host, url, seq of the pages that the sites' sitemaps name, fetched live: /sitemap.xml, then those of robots.txt, nested ones as they are found."""
    sites = spark.createDataFrame([(u,) for u in start_urls], "given string").select(urls.normalize(F.col("given")).alias("url")).filter("url is not null").distinct()
    robots = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.netloc(F.col("url")), F.lit("/robots.txt"))
    start = materialise(discovery_order(with_texts(sites.withColumn("robots", robots), "robots", timeout=timeout)), "robots")
    return expand_sitemaps(lambda level: with_texts(level, text="xml", timeout=timeout), start, max_urls)


def live_pages(fetch: Callable[[str], Fetched] = fetch, delay: float = 0.0, tasks: int = 64, robots=robots_rules) -> Callable[[DataFrame], DataFrame]:
    """The live web as a crawl's source: run_crawl(spark, live_pages(), config, lambda: discover(...))."""
    return lambda level: fetch_pages(level, fetch, delay, tasks, robots)


def live_crawl(spark: SparkSession, config: CrawlConfig, path: str | None = None, told: Callable[[dict], None] | None = None, **options) -> Crawl:
    """Crawl live sites from their start URLs and sitemaps, as many requests at once as the configuration has workers for a platform; goes on where the log in `path` ends."""
    if config.max_pages is None:
        raise ValueError("a crawl of live sites needs a budget of pages")
    found = lambda: discover(spark, list(config.start_urls), config.max_pages)
    return run_crawl(spark, live_pages(**options), config, found if config.include_sitemap else None, path, told)


def read_urls(spark: SparkSession, given: DataFrame | list[str], workers: int = 3, tasks: int = 8, delay: float = 0.0) -> DataFrame:
    """A row per URL as a source of its own: source_url, title, blocks, source_name, verified, verified_from, tags and error; a page without blocks is an error.

    given: a table with a column url, or a short list."""
    rows = given if isinstance(given, DataFrame) else spark.createDataFrame([(u,) for u in given], "url string")
    wanted = rows.select(urls.normalize(F.col("url")).alias("url")).filter("url is not null").distinct().withColumn("workers", F.lit(workers))
    pages = fetch_pages(wanted, delay=delay, tasks=tasks).drop("workers")
    rows = with_parsed(pages.withColumnRenamed("url", "source_url")).withColumn("source", urls.source(F.col("source_url")))
    error = F.coalesce("failed", "error", F.when(F.size("blocks") == 0, "no paragraph-level content was found on the page"))
    return rows.select("source_url", "title", "blocks", "source.source_name", "source.verified", "source.verified_from", "source.tags", error.alias("error"))


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.parts = max(1, int(options.get("partitions", "8")))

    def partitions(self):
        return [_Part(self.urls[i :: self.parts]) for i in range(min(self.parts, max(1, len(self.urls))))]

    def read(self, partition):
        visitor = Visitor()
        for url in partition.urls:
            yield url, *visitor.visit(url)


class WebPages(DataSource):
    @classmethod
    def name(cls):
        return "web_pages"

    def schema(self):
        return "url string, html string, error string"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)
