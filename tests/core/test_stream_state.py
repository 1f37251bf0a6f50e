"""Admission in keyed state, counters and manifests while jobs run, and exports that compute their input once."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom.operators import crawl
from textloom.sources import jobs, sinks
from textloom.streaming import admission, incremental

CANDIDATES = "platform_id string, url string, root_host string, seq long"


@pytest.fixture
def disk_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    admission.use_disk_store(spark)
    yield
    spark.conf.set(key, before)


def candidates(spark, folder, rows):
    spark.createDataFrame(rows, CANDIDATES).coalesce(1).write.mode("append").parquet(folder)


def admitted(spark, base, max_pages, ttl_ms=None, expected=None):
    """What is admitted when the input is read; with a time to live, when as many are there as expected."""
    rows = spark.readStream.schema(CANDIDATES).parquet(f"{base}/in")
    writer = admission.admit_stream(rows, max_pages, ttl_ms).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    read = lambda: {(r.platform_id, r.url, r.nth) for r in spark.read.schema(admission.ADMITTED).parquet(f"{base}/out").collect()}
    if ttl_ms is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return read()
    query, deadline = writer.trigger(processingTime="200 milliseconds").start(), time.time() + 30
    while time.time() < deadline and (not query.recentProgress or len(read()) < expected):
        time.sleep(0.3)
    query.stop()
    return read()


def rows_of(platform, numbers):
    return [(f"https://{platform}/", f"https://{platform}/{'news/' if i % 11 == 10 else ''}p{i}", platform, k) for k, i in enumerate(numbers)]


def test_the_same_urls_as_the_batch_admits(spark, disk_store, tmp_path):
    """One hot platform, one small; repeats; URLs that may not enter; stopped and started again between two parts."""
    hot, small = rows_of("a.org", [i * 7 % 300 for i in range(900)]), rows_of("b.org", range(5)) + [("https://b.org/", "https://z.org/x", "b.org", 9), ("https://b.org/", "https://b.org/f.pdf", "b.org", 8)]
    candidates(spark, f"{tmp_path}/in", hot[:400] + small)
    first = admitted(spark, tmp_path, 60)
    batch = crawl.admit(spark.createDataFrame(hot[:400] + small, CANDIDATES), None, 1, 60)
    assert {(p, u) for p, u, _ in first} == {(r.platform_id, r.url) for r in batch.collect()}
    assert sorted(n for p, _, n in first if "a.org" in p) == list(range(1, 61))
    # the budget is spent: nothing more of a.org; b.org has room, and knows what it has
    candidates(spark, f"{tmp_path}/in", hot[400:] + small + rows_of("b.org", range(3, 8)))
    second = admitted(spark, tmp_path, 60)
    assert first <= second and {(p, u) for p, u, _ in second - first} == {("https://b.org/", f"https://b.org/p{i}") for i in (5, 6, 7)}


def test_known_urls_expire_but_the_budget_does_not(spark, disk_store, tmp_path):
    candidates(spark, f"{tmp_path}/in", rows_of("a.org", range(3)))
    assert len(admitted(spark, tmp_path, 5, 1500, 3)) == 3
    time.sleep(2)
    candidates(spark, f"{tmp_path}/in", rows_of("a.org", range(3)))
    again = admitted(spark, tmp_path, 5, 1500, 5)
    assert sorted(n for *_, n in again) == [1, 2, 3, 4, 5]  # two of the three once more, then the budget is spent


def test_a_stream_counts_while_it_runs(spark, tmp_path):
    from textloom.plans import overlay

    body = "</p><p>".join(overlay.SNIPPETS[0].split("\n\n"))
    rows = [(i, f"https://a.org/malaria/{i % 9}", f"<title>Malaria</title><p>{body if i % 2 else 'nothing'}</p>") for i in range(12)]
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], incremental.PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    counters = incremental.Counters()
    spark.streams.addListener(counters)
    try:
        query = incremental.start_export(incremental.read_pages(spark, f"{tmp_path}/in", files_per_batch=1), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        query.awaitTermination()
        deadline = time.time() + 20
        while time.time() < deadline and counters.by_query.get(str(query.id), {}).get("batches", 0) < 3:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    got = counters.by_query[str(query.id)]
    assert got["batches"] == 3 and got["scraped"] == 9 == got["accepted"] + got["rejected"]
    assert got["accepted"] == spark.read.text(f"{tmp_path}/out").count()


def test_the_manifest_of_a_running_crawl(spark, tmp_path):
    config, clock = crawl.CrawlConfig(("https://a.org/malaria",), max_pages=10), [0.0]
    told = jobs.keeper(spark, f"{tmp_path}/jobs", config, "../odd id", clock=lambda: clock[0])
    read = lambda: jobs.read_manifests(spark, f"{tmp_path}/jobs").first()
    level = {"depth": 0, "discovered": 4, "failed": 1, "accepted": 2, "rejected": 1}
    told(level)
    assert (read().job_id, read().status, read().discovered_pages, read().scraped_pages) == ("../odd id", "running", 4, 4)
    clock[0] = 1.0
    told(level | {"depth": 1})
    assert read().discovered_pages == 4  # too early
    clock[0] = 2.0
    told(level | {"depth": 2})
    assert read().discovered_pages == 12 and read().accepted_pages == 6
    assert [p.name for p in Path(f"{tmp_path}/jobs").rglob("job.json*") if not p.name.startswith(".")] == ["job.json"]


def test_one_job_is_read_alone_and_jobs_are_reset(spark, tmp_path):
    root = f"{tmp_path}/jobs"
    jobs.write_manifests(jobs.with_defaults(spark.createDataFrame([{"job_id": x, "status": s} for x, s in (("a", "running"), ("b/c", "completed"), ("..", "failed"))], jobs.MANIFEST)), root)
    assert sorted(r.job_id for r in jobs.read_manifests(spark, root).collect()) == ["..", "a", "b/c"]
    Path(f"{root}/a/job.json").rename(f"{root}/a/gone")  # another job's folder is not looked at
    assert jobs.read_job(spark, root, "b/c").first().status == "completed" and jobs.read_job(spark, root, "a").count() == 0
    read = jobs.read_job(spark, root, "..")
    assert read.first().status == "failed" and len(read.inputFiles()) == 1
    assert jobs.reset(spark, root, spark.createDataFrame([("b/c",), ("none",)], "job_id string")) == 1
    assert jobs.reset(spark, root) == 1 and jobs.read_manifests(spark, root).count() == 0


def test_an_array_of_json_computes_its_records_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(500).select(F.struct(counted(F.col("id").cast("string")).alias("title")).alias("data"), "id")
    sinks.export(rows, f"{tmp_path}/out", "json", order=["id"])
    sinks.one_file(spark, f"{tmp_path}/out", f"{tmp_path}/one.json")
    assert seen.value == 500
    assert [r["title"] for r in json.loads(Path(f"{tmp_path}/one.json").read_text())] == [str(i) for i in range(500)]
