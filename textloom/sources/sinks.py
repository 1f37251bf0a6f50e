"""Exports of records: JSON lines, CSV, one JSON array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans import lexicon as lx
from textloom.plans.storage import materialise

CSV_COLUMNS = (*lx.EXPORT_FIELDS, "language", "quality_score", "raw_text")
CSV_OPTIONS = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def json_line() -> Column:
    """A record with its blocks, language, score and tags as one line of JSON."""
    return F.to_json(F.struct("data", F.col("accepted").alias("raw_blocks"), "language", F.col("score").alias("quality_score"), "tags"), {"ignoreNullFields": "false"})


def csv_rows(records: DataFrame) -> DataFrame:
    """The 23 columns of the CSV: lists between bars, nested fields as JSON, blocks at blank lines."""

    def value(name: str) -> Column:
        c = F.col(f"data.{name}")
        return F.array_join(c, " | ") if name in lx.LIST_FIELDS else F.to_json(c) if name in ("severity_levels", "confidence_rules") else c

    return records.select(
        *(value(f).alias(f) for f in lx.EXPORT_FIELDS), "language", F.col("score").alias("quality_score"),
        F.array_join("accepted", "\n\n").alias("raw_text")
    )


def json_parts(records: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """The pieces of one JSON array of the records' data, indented, in the order of these columns, ties by the data itself.

    Sorted by ranges, so no task holds more than its share; the parts in order of their names are the array. A comma begins the line of each record but the first.
    The lines are written to the shared folder first, so that the records are computed once, and not again for the first line and the ranges. Without
    an order it is that of the lines themselves."""
    given = [F.col(c) for c in order]
    keys = [f"k{i}" for i in range(len(given))]
    rows = records.select(*(c.alias(k) for c, k in zip(given, keys, strict=True)), F.to_json("data", {"ignoreNullFields": "false", "pretty": "true"}).alias("line"))
    rows = materialise(rows.groupBy(*keys, "line").agg(F.count("*").alias("n")), "json-lines")
    first = rows.agg(F.min(F.struct(*keys, "line")).alias("first"))
    body = F.concat(F.when(F.struct(*keys, "line") == F.col("first"), "").otherwise(","), F.array_join(F.array_repeat("line", F.col("n").cast("int")), "\n,"))
    pieces = rows.crossJoin(F.broadcast(first)).select(F.lit(1).alias("part"), *keys, "line", body.alias("value"))
    edge = lambda part, text: first.select(
        F.lit(part).alias("part"), *(F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys), F.lit("").alias("line"),
        F.lit(text).alias("value")
    )
    return edge(0, "[").unionByName(pieces).unionByName(edge(2, "]")).orderBy("part", *keys, "line").select("value")


def one_file(spark: SparkSession, folder: str, path: str) -> None:
    """The parts of a folder one after the other as one file, as a stream: for a download, not for data that tasks read."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source, target = hadoop.Path(folder), hadoop.Path(path)
    files = source.getFileSystem(conf)
    parts = sorted(x.getPath().toString() for x in files.listStatus(source) if x.getPath().getName().startswith("part-"))
    out = target.getFileSystem(conf).create(target, True)
    try:
        for part in parts:
            read = files.open(hadoop.Path(part))
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 16, False)
            finally:
                read.close()
    finally:
        out.close()


def export(records: DataFrame, path: str, kind: str, mode: str = "overwrite", order: Sequence[str] = ()) -> None:
    """Written in parts by all tasks. The parts of json are one array, in the order of the given columns; see one_file."""
    if kind == "jsonl":
        records.select(json_line().alias("value")).write.mode(mode).text(path)
    elif kind == "csv":
        csv_rows(records).write.mode(mode).options(**CSV_OPTIONS).csv(path)
    elif kind == "json":
        if mode == "append":
            raise ValueError("an array cannot be appended to; export jsonl")
        json_parts(records, order).write.mode(mode).text(path)
    else:
        raise ValueError(f"no export of kind {kind}; there are json, jsonl and csv")


def preview(records: DataFrame, rows: int = 10) -> DataFrame:
    return records.limit(rows)
