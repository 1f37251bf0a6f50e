"""Crawl manifests as a table: a job.json a folder, read with a declared schema and a default for each field that is missing.

A stream's checkpoint keeps the state of a crawl of ours; manifests are for reading jobs that others left,
for finding those with work left, and for the views of a job.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import urls
from textloom.operators.crawl import Crawl, CrawlConfig, completion_message, error_tail
from textloom.plans.storage import exists, remove

QUEUE_ITEM = "struct<url:string,depth:int,platform_id:string,root_host:string,source_name:string,verified:boolean,verified_from:string,tags:array<string>>"
PLATFORM = "struct<platform_id:string,label:string,start_url:string,root_host:string,max_pages:int,discovered_pages:int,scraped_pages:int,accepted_pages:int,rejected_pages:int,status:string,status_message:string>"
MANIFEST = (
    "job_id string, status string, status_message string, start_url string, start_urls array<string>, platform_max_pages int, max_pages int, max_depth int, include_sitemap boolean, concurrency int, "
    "discovered_pages int, scraped_pages int, accepted_pages int, rejected_pages int, failed_pages int, errors array<string>, messages array<string>, "
    f"queue_items array<{QUEUE_ITEM}>, in_progress_items array<{QUEUE_ITEM}>, queued_urls array<string>, in_progress_urls array<string>, processed_urls array<string>, platform_states array<{PLATFORM}>, pause_requested boolean, cancel_requested boolean"
)

# What a missing field of a manifest stands for.
DEFAULTS = {
    "status": "queued", "status_message": "Queued.", "start_url": "", "platform_max_pages": 0, "max_pages": 1000,
    "max_depth": 2, "include_sitemap": True, "concurrency": 4, "discovered_pages": 0, "scraped_pages": 0,
    "accepted_pages": 0, "rejected_pages": 0, "failed_pages": 0, "pause_requested": False, "cancel_requested": False
}
PENDING = ("queued", "running")


def _some(name: str) -> Column:
    """The non-empty strings of an array, none where it is missing."""
    return F.coalesce(F.filter(name, lambda x: x != ""), F.array().cast("array<string>"))


def queue_item(x: Column) -> Column:
    """With defaults; an item without a platform belongs to its host, or to its own URL."""
    text = lambda f: F.coalesce(x[f], F.lit(""))
    platform = F.when(text("platform_id") != "", x["platform_id"]).when(text("root_host") != "", x["root_host"]).otherwise(text("url"))
    tags = F.coalesce(F.filter(x["tags"], lambda t: t != ""), F.array().cast("array<string>"))
    return F.struct(
        text("url").alias("url"), F.coalesce(x["depth"], F.lit(0)).alias("depth"), platform.alias("platform_id"),
        text("root_host").alias("root_host"), text("source_name").alias("source_name"),
        F.coalesce(x["verified"], F.lit(False)).alias("verified"), text("verified_from").alias("verified_from"),
        tags.alias("tags")
    )


def _items(name: str) -> Column:
    return F.transform(F.coalesce(F.col(name), F.array().cast(f"array<{QUEUE_ITEM}>")), queue_item)


def _first(values: Column, key) -> Column:
    """Of values with an equal key the first; manifests hold a few platforms each."""
    keys = F.transform(values, key)
    return F.filter(values, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def _platform(x: Column) -> Column:
    text = {f: F.coalesce(x[f], F.lit(d)) for f, d in (("platform_id", ""), ("label", ""), ("start_url", ""), ("root_host", ""))}
    count = {f: F.coalesce(x[f], F.lit(0)) for f in ("max_pages", "discovered_pages", "scraped_pages", "accepted_pages", "rejected_pages")}
    said = {"status": F.coalesce(x["status"], F.lit("queued")), "status_message": F.coalesce(x["status_message"], F.lit("Queued."))}
    return F.struct(*(c.alias(f) for f, c in (text | count | said).items()))


def _from_seed(url: Column) -> Column:
    """The platform of a start URL, where a manifest has none."""
    limit = F.when(F.col("platform_max_pages") > 0, F.col("platform_max_pages")).otherwise(F.col("max_pages"))
    zero = F.lit(0)
    return F.struct(
        url.alias("platform_id"), urls.source(url)["source_name"].alias("label"), url.alias("start_url"),
        urls.root_host(url).alias("root_host"), limit.alias("max_pages"), zero.alias("discovered_pages"),
        zero.alias("scraped_pages"), zero.alias("accepted_pages"), zero.alias("rejected_pages"),
        F.lit("queued").alias("status"), F.lit("Queued.").alias("status_message")
    )


def with_defaults(manifests: DataFrame) -> DataFrame:
    """Rows of MANIFEST with defaults, start URLs and platforms once each, platforms made from start URLs where there are none."""
    rows = manifests.withColumns({f: F.coalesce(f, F.lit(d)) for f, d in DEFAULTS.items()})
    rows = rows.withColumns({f: _some(f) for f in (
        "queued_urls", "in_progress_urls", "processed_urls", "errors", "messages"
    )} | {f: _items(f) for f in ("queue_items", "in_progress_items")})
    rows = rows.withColumn("start_urls", F.array_distinct(_some("start_urls")))
    given = F.transform(F.coalesce("platform_states", F.array().cast(f"array<{PLATFORM}>")), _platform)
    rows = rows.withColumn("__given", given)
    return rows.withColumn(
        "platform_states",
        F.when(F.size("__given") > 0, _first(F.col("__given"), lambda x: x["platform_id"])).otherwise(F.transform("start_urls", _from_seed))
    ).drop("__given")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """The manifests under root/*/job.json; a job without an id has its folder's name, one that is broken has a row of defaults and `broken`."""
    try:
        rows = spark.read.schema(f"{MANIFEST}, _corrupt_record string").option("multiLine", True).json(f"{root}/*/job.json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return with_defaults(spark.createDataFrame([], f"{MANIFEST}, broken boolean"))
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/job\.json\z", 1)
    rows = rows.select("*", folder.alias("__folder"))
    return with_defaults(rows.withColumn("job_id", F.coalesce("job_id", "__folder")).withColumn("broken", F.col("_corrupt_record").isNotNull()).drop("__folder", "_corrupt_record"))


def read_job(spark: SparkSession, root: str, job_id: str) -> DataFrame:
    """The manifest of one job, of whose folder alone anything is read; no row where there is none."""
    path = f"{_folder(root, job_id)}/job.json"
    return with_defaults(spark.read.schema(MANIFEST).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], MANIFEST))


def reset(spark: SparkSession, root: str, job_ids: DataFrame | None = None) -> int:
    """Removes the folders of these jobs (job_id), or of all, and tells how many there were. The ids come to the driver one by one: jobs are few."""
    wanted = read_manifests(spark, root).select("job_id") if job_ids is None else job_ids.select("job_id").distinct()
    there = [path for row in wanted.toLocalIterator() if exists(spark, path := _folder(root, row.job_id))]
    for path in there:
        remove(spark, path)
    return len(there)


def _folder(root: str, job_id: str) -> str:
    """A job's folder: its id is one name, whatever is in it."""
    return f"{root}/{quote(job_id, safe='').replace('.', '%2E')}"


def snapshot(crawl: Crawl, config: CrawlConfig, job_id: str) -> DataFrame:
    """The manifest of a crawl that is over, as one row of MANIFEST: its settings, counters, platforms and last errors; queues and URL sets are empty."""
    spark = crawl.progress.sparkSession
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("int").alias(f"{c}_pages")
    whole = crawl.progress.agg(*map(count, ("discovered", "scraped", "accepted", "rejected", "failed")))
    state = [
        F.col("platform_id"), urls.source(F.col("platform_id"))["source_name"].alias("label"),
        F.col("platform_id").alias("start_url"), urls.root_host(F.col("platform_id")).alias("root_host"),
        F.lit(config.max_pages or 0).alias("max_pages"),
        *(F.col(c).cast("int").alias(f"{c}_pages") for c in ("discovered", "scraped", "accepted", "rejected")), "status",
        F.col("message").alias("status_message")
    ]
    platforms = crawl.progress.select(F.struct(*state).alias("p")).agg(F.sort_array(F.collect_list("p")).cast(f"array<{PLATFORM}>").alias("platform_states"))
    errors = error_tail(crawl.errors, "url").agg(F.sort_array(F.collect_list("error")).alias("errors"))
    none = lambda name: F.array().cast(f"array<{QUEUE_ITEM}>" if name.endswith("items") else "array<string>").alias(name)
    given = {
        "job_id": job_id, "start_url": config.start_urls[0], "platform_max_pages": config.max_pages or 0,
        "max_pages": config.total_pages, "max_depth": config.max_depth, "include_sitemap": config.include_sitemap,
        "concurrency": config.concurrency, "pause_requested": False, "cancel_requested": False
    }
    row = whole.crossJoin(platforms).crossJoin(errors)
    row = row.withColumn("status", F.when(F.col("accepted_pages") > 0, "completed").otherwise("failed"))
    message = completion_message(F.col("accepted_pages"), F.col("failed_pages"), F.lit(False))
    row = row.select(
        "*", F.coalesce(message, F.lit("Completed.")).alias("status_message"),
        F.array(*map(F.lit, config.start_urls)).alias("start_urls"), *(F.lit(v).alias(k) for k, v in given.items()),
        *map(none, ("messages", "queue_items", "in_progress_items", "queued_urls", "in_progress_urls", "processed_urls"))
    )
    return row.select(*(f.name for f in spark.createDataFrame([], MANIFEST).schema.fields))


def write_manifests(jobs: DataFrame, root: str) -> None:
    """root/<job_id>/job.json of each job, each replaced as a whole; jobs are few, and a manifest is one row."""
    spark = jobs.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    names = [f.name for f in spark.createDataFrame([], MANIFEST).schema.fields]
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = getattr(hadoop.Options.Rename, "OVERWRITE")
    for row in jobs.select("job_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("body")).toLocalIterator():
        folder = _folder(root, row.job_id)
        path, new = hadoop.Path(f"{folder}/job.json"), hadoop.Path(f"{folder}/job.json.new")
        files = path.getFileSystem(conf)
        out = files.create(new, True)
        out.write(bytearray(row.body.encode()))
        out.close()
        # one step where the file system has it: there is a whole manifest at any moment
        hadoop.FileContext.getFileContext(path.toUri(), conf).rename(new, path, over)


def keeper(spark: SparkSession, root: str, config: CrawlConfig, job_id: str, every: float = 1.25, clock: Callable[[], float] = time.monotonic) -> Callable[[dict], None]:
    """For run_crawl's `told`: keeps the manifest of a running crawl, from the counts of its levels. It is written once in `every` seconds at most, the first at once;
    what is not written then is in the next, or in the snapshot of the whole."""
    sums, last = Counter(), [-every]

    def told(level: dict) -> None:
        sums.update({k: level[k] for k in ("discovered", "failed", "accepted", "rejected")})
        if clock() - last[0] < every:
            return
        given = {
            "job_id": job_id, "status": "running", "status_message": f"Depth {level['depth']} done.", "start_url": config.start_urls[0], "start_urls": list(config.start_urls),
            "platform_max_pages": config.max_pages or 0, "max_pages": config.total_pages, "max_depth": config.max_depth, "include_sitemap": config.include_sitemap,
            "concurrency": config.concurrency, "discovered_pages": sums["discovered"], "scraped_pages": sums["accepted"] + sums["rejected"] + sums["failed"],
            **{f"{k}_pages": sums[k] for k in ("accepted", "rejected", "failed")}
        }
        write_manifests(with_defaults(spark.createDataFrame([given], MANIFEST)), root)
        last[0] = clock()

    return told


def pending(jobs: DataFrame) -> DataFrame:
    """Jobs that are queued or running with something in the queue or in progress."""
    return jobs.filter(F.col("status").isin(*PENDING) & ((F.size("queue_items") > 0) | (F.size("in_progress_urls") > 0)))


def job_ids(*sets: DataFrame) -> DataFrame:
    """The distinct job ids of all sets."""
    out = sets[0].select("job_id")
    for s in sets[1:]:
        out = out.union(s.select("job_id"))
    return out.distinct()


def _tail(name: str, n: int) -> Column:
    return F.slice(name, F.greatest(F.size(name) - n + 1, F.lit(1)), F.lit(n))


def job_view(jobs: DataFrame) -> DataFrame:
    """What a caller sees of a job: counters, the last 20 errors and messages, download paths once it is completed."""
    link = lambda kind: F.when(
        F.col("status") == "completed", F.concat(F.lit("/api/crawl/"), "job_id", F.lit(f"/download/{kind}"))
    ).alias(f"download_{kind}_url")
    same = (
        "job_id", "status", "status_message", "start_url", "start_urls", "max_pages", "max_depth", "include_sitemap",
        "concurrency", "discovered_pages", "scraped_pages", "accepted_pages", "rejected_pages", "failed_pages"
    )
    return jobs.select(
        *same, platform_view().alias("platform_progress"), _tail("errors", 20).alias("errors"),
        _tail("messages", 20).alias("messages"), *map(link, ("json", "jsonl", "csv"))
    )


def platform_view() -> Column:
    return F.transform("platform_states", lambda x: x.dropFields("root_host"))


def finished(jobs: DataFrame) -> DataFrame:
    """A snapshot of jobs that are over: their queues and URL sets are emptied."""
    over = F.col("status").isin("completed", "failed", "cancelled")
    return jobs.withColumns({f: F.when(over, F.slice(f, 1, 0)).otherwise(F.col(f)) for f in (
        "queue_items", "in_progress_items", "queued_urls", "in_progress_urls", "processed_urls"
    )})
