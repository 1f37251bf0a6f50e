"""Record fingerprints, first-wins dedup and merging of record sets."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import fingerprint_list, fingerprint_text
from textloom.plans.lexicon import FINGERPRINT_LISTS, FINGERPRINT_TEXTS


def fingerprint(data: str = "data") -> Column:
    """sha256 of the canonical JSON of eleven normalised fields, in order of name."""
    parts = {f: fingerprint_text(F.col(f"{data}.{f}")) for f in FINGERPRINT_TEXTS} | {f: fingerprint_list(F.col(f"{data}.{f}")) for f in FINGERPRINT_LISTS}
    return F.sha2(F.to_json(F.struct(*(parts[f].alias(f) for f in sorted(parts)))), 256)


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the given order. Spark limits each task to one row a key before the shuffle, so a key with many rows is no hot spot."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def deduplicate(records: DataFrame, order: list[str], data: str = "data") -> DataFrame:
    """First of each fingerprint, with the fingerprint."""
    return first_of_each(records.withColumn("fingerprint", fingerprint(data)), ["fingerprint"], order)


def merge_records(*sets: DataFrame, order: str, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """The distinct records of all sets, first set first; and a row of counts: merged, duplicates, source files."""
    rows = functools.reduce(DataFrame.unionByName, (s.withColumn("file_idx", F.lit(i)) for i, s in enumerate(sets)))
    unique = deduplicate(rows, ["file_idx", order], data)
    marked = rows.select(fingerprint(data).alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))
    counts = marked.agg(
        F.count("*").alias("merged_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count")
    ).withColumn("source_file_count", F.lit(len(sets)).cast("long"))
    said = F.format_string(
        "Merged %d records from %d files into %d unique records.", F.col("merged_count") + F.col("duplicate_count"),
        "source_file_count", "merged_count"
    )
    return unique, counts.withColumn("message", said)


def distinct_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(tags))
