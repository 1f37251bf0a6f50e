"""Take in new pages: a file stream with a checkpoint that parses what has arrived since the last run, each URL once.

    python -m jobs.page_intake --config jobs/page_intake.json --input PAGES --output FOLDER --checkpoint FOLDER

Input: Parquet files of page_id, url, html in one folder, or that a pattern names. A run takes the files that no earlier run took, and ends. Of each batch the first page of a normalised URL by
page_id counts, and URLs of earlier batches are passed over, so a page that is seen again under any spelling of its URL is not taken in twice.
Output: Parquet, partitioned by batch: the page's title, source, links, accepted text and score; a page that can't be parsed is a row with an error.

The checkpoint fixes which files a batch has. A batch that is cut off is run again with the same number, reads only earlier batches beside its own files, and
replaces its own partition, so nothing is lost and nothing is twice. Of earlier batches only the URL is read. An output and its checkpoint belong together. Rows without a URL are counted and left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import arguments, lexicon, log, read_config, session
from textloom.functions import urls
from textloom.operators import dedup, records
from textloom.operators.html import with_parsed
from textloom.plans.lexicon import Lexicon

PAGES = "page_id long, url string, html string"
TAKEN = "page_id long, url string, host string, source string, title string, links long, blocks long, rejected long, score double, text string, error string, batch long"


def taken(pages: DataFrame, words: Lexicon) -> DataFrame:
    """A row per page with a URL: what is kept of it."""
    rows = records.accept_blocks(records.clean_blocks(with_parsed(pages.select("page_id", "url", "html")), "blocks", "cleaned", words), "cleaned", words)
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    return rows.select(
        "page_id", "url", urls.root_host(F.col("url")).alias("host"), urls.source(F.col("url"))["source_name"].alias("source"), "title", size("hrefs").alias("links"),
        size("accepted").alias("blocks"), size("rejected").alias("rejected"), "score", F.array_join("accepted", "\n\n").alias("text"), F.coalesce("error", F.lit("")).alias("error")
    )


def run(spark: SparkSession, input_path: str, output_path: str, checkpoint_path: str, config: dict) -> dict[str, int]:
    """Takes what is new and waits until it is done. Counts of what was read and written by this run."""
    words, counts = lexicon(config["lexicon"]), {"batches": 0, "read": 0, "without_url": 0, "written": 0}

    def take(batch: DataFrame, number: int) -> None:
        read, written = Observation(), Observation()
        named = batch.withColumn("url", urls.normalize(F.col("url"))).observe(read, F.count(F.lit(1)).alias("read"), F.count_if(F.col("url").isNull()).alias("without_url"))
        first = dedup.first_of_each(named.filter("url is not null"), ["url"], ["page_id", "html"])
        new = first
        if number:
            known = batch.sparkSession.read.schema(TAKEN).parquet(output_path).filter(F.col("batch") < number)
            new = first.join(known.select("url"), "url", "left_anti")
        rows = taken(new, words).withColumn("batch", F.lit(number).cast("long")).observe(written, F.count(F.lit(1)).alias("written"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output_path)
        for k, v in {"batches": 1, **read.get, **written.get}.items():
            counts[k] += v or 0
        log.info("page_intake: batch %d: %s, %s", number, read.get, written.get)

    log.info("page_intake: new files of %s", input_path)
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", config.get("files_per_batch", 200)).parquet(input_path)
    query = pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("page_intake: wrote %s: %s", output_path, counts)
    return counts


def main() -> None:
    given = arguments(__doc__.splitlines()[0], "input", "output", "checkpoint")
    spark = session("page_intake")
    try:
        run(spark, given.input, given.output, given.checkpoint, read_config(spark, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
