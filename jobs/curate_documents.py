"""Curate a table of documents: clean blocks, keep those with evidence, score, drop documents that repeat another, write by language.

    python -m jobs.curate_documents --config jobs/curate_documents.json --input DOCUMENTS --output FOLDER

Input: doc_id, text, lang, source (other columns are passed over). A document's text is cut into blocks, which are normalised, cut to those of
min_block characters at least, and freed of repeats; blocks with evidence by the config's lexicon are accepted. Of documents whose accepted text is the same but for case
the first by doc_id stays. Output: Parquet, partitioned by lang.

Nothing but the dedup is shuffled, and for that each task keeps one row a fingerprint first, so copies are no hot spot. A rerun
replaces the output and gives the same rows. A null text has no blocks; documents without an accepted block are counted and left out; a null lang is `default_lang`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import arguments, lexicon, log, read_config, session
from textloom.functions import text as tx
from textloom.operators import dedup, records

COLUMNS = ("doc_id", "source", "blocks", "rejected", "score", "fingerprint", "text", "lang")


def curated(docs: DataFrame, config: dict) -> DataFrame:
    """A row per document with its accepted text, before the dedup; documents without any have no row."""
    words = lexicon(config["lexicon"])
    rows = docs.select(
        F.col("doc_id").cast("long"), "source", F.coalesce("lang", F.lit(config.get("default_lang", "unknown"))).alias("lang"),
        tx.text_blocks(F.coalesce("text", F.lit(""))).alias("raw")
    )
    rows = records.accept_blocks(records.clean_blocks(rows, "raw", "cleaned", words), "cleaned", words)
    out = rows.select(
        "doc_id", "source", F.size("accepted").cast("long").alias("blocks"), F.size("rejected").cast("long").alias("rejected"), "score",
        F.sha2("joined", 256).alias("fingerprint"), F.array_join("accepted", "\n\n").alias("text"), "lang"
    )
    return out.select(*COLUMNS)


def run(spark: SparkSession, input_path: str, output_path: str, config: dict) -> dict[str, int]:
    """Counts of what was read and written."""
    read, written = Observation("read"), Observation("written")
    rows = curated(spark.read.parquet(input_path), config).observe(
        read, F.count(F.lit(1)).alias("documents"), F.count_if(F.col("blocks") == 0).alias("without_blocks"), F.sum("blocks").alias("blocks"), F.sum("rejected").alias("rejected")
    )
    kept = dedup.first_of_each(rows.filter("blocks > 0"), ["fingerprint"], ["doc_id", "text"]).select(*COLUMNS)
    kept = kept.observe(written, F.count(F.lit(1)).alias("kept"))
    log.info("curate_documents: reading %s", input_path)
    kept.write.mode("overwrite").partitionBy("lang").parquet(output_path)
    counts = {k: v or 0 for k, v in (read.get | written.get).items()}
    counts["repeated"] = counts["documents"] - counts["without_blocks"] - counts["kept"]
    log.info("curate_documents: wrote %s: %s", output_path, counts)
    return counts


def main() -> None:
    given = arguments(__doc__.splitlines()[0], "input", "output")
    spark = session("curate_documents")
    try:
        run(spark, given.input, given.output, read_config(spark, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
