"""Records as pages arrive: Structured Streaming over a folder of page files.

A query that is stopped goes on from its checkpoint with nothing lost and nothing twice. Pages are
admitted once by canonical URL; with no event time that state grows with the number of distinct URLs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from textloom.functions import urls
from textloom.operators.html import with_parsed
from textloom.operators.records import build_records
from textloom.plans.lexicon import DEFAULT, Lexicon
from textloom.sources.sinks import json_line

PAGES = "page_id long, url string, html string"


def page_records(pages: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Stateless, and by the crawl's own parser, so it is the same on a stream, on a table and in a crawl. Pages that the parser rejects have no record."""
    rows = with_parsed(pages.select("page_id", urls.normalize(F.col("url")).alias("source_url"), "html"))
    return build_records(rows.filter("error is null").drop("hrefs", "error"), lexicon, even=True)


def read_pages(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once_per_url(pages: DataFrame) -> DataFrame:
    return pages.withColumn("__url", urls.normalize(F.col("url"))).dropDuplicates(["__url"]).drop("__url")


def start_export(pages: DataFrame, path: str, checkpoint: str, lexicon: Lexicon = DEFAULT, every: str | None = None) -> StreamingQuery:
    """Append accepted records as JSON lines; every: a processing-time trigger, or all there is and stop."""
    records = page_records(once_per_url(pages), lexicon).observe(
        "records", F.count(F.lit(1)).alias("scraped"), F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected")
    )
    accepted = records.filter("reject_reason is null")
    writer = accepted.select(json_line().alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Counters(StreamingQueryListener):
    """Counts of records while streams run, by query id, from what their batches observed as they were written: no pass of their own. Register it by spark.streams.addListener."""

    def __init__(self):
        self.by_query: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        self.by_query.setdefault(str(event.id), {"batches": 0, "scraped": 0, "accepted": 0, "rejected": 0})

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("records")
        if seen is not None:
            own = self.by_query.setdefault(str(event.progress.id), {"batches": 0, "scraped": 0, "accepted": 0, "rejected": 0})
            own["batches"] += 1
            for k in ("scraped", "accepted", "rejected"):
                own[k] += seen[k]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def pause(query: StreamingQuery) -> None:
    """Stop after the batch at hand; start_export with the same checkpoint goes on."""
    query.stop()


def cancel(query: StreamingQuery, spark: SparkSession, checkpoint: str) -> None:
    """Stop, and discard the state: a stream begun again with this checkpoint starts anew. What was exported stays."""
    query.stop()
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def progress(query: StreamingQuery) -> dict:
    last = query.lastProgress
    return {"active": query.isActive, "rows": last.numInputRows if last else 0, "batch": last.batchId if last else -1}
