"""Helpers shared by the training-data operators.

Python stages work on Arrow batches and cut them into chunks of bounded size, so
memory follows the chunk and not the partition.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.plans.storage import drop_written, materialise, new_path, release, remove, written  # noqa: F401

CHUNK_BYTES = 2 << 20
_HELD: list[tuple[DataFrame, int]] = []  # with the thread that holds it


def files_for(rows: int, each: int = 2_000_000) -> int:
    """How many files to deal a narrow table to whose rows are at most in proportion to these."""
    return max(1, -(-rows // each))


def held(df: DataFrame) -> DataFrame:
    """df, persisted on the executors' disks as it is first computed: for tables read more than once within an operator. What a lost executor held is computed again."""
    out = df.persist(StorageLevel.DISK_ONLY)
    _HELD.append((out, threading.get_ident()))
    return out


def held_now() -> list[DataFrame]:
    """What this thread holds; other threads may be at work on theirs."""
    return [table for table, thread in _HELD if thread == threading.get_ident()]


def drop_held(but: list[DataFrame]) -> None:
    """Let go of all that this thread holds but these."""
    for table in held_now():
        if not any(table is x for x in but):
            table.unpersist()
            _HELD[:] = [x for x in _HELD if x[0] is not table]


def named(column: str) -> Column:
    """The column of this very name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def private(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as it takes to be none of df's (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Bound what Spark sends to Python at once by CHUNK_BYTES, for this session: its default of 64 MB a batch is held
    by the JVM and by the worker, in each task. A lower bound stays as it is; a row is never cut."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > CHUNK_BYTES:
        spark.conf.set(key, str(CHUNK_BYTES))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of the named text column, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def map_chunks(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema, limit: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow over chunks; make() runs once a task and gives the function for a chunk."""

    def run(batches):
        work = make()
        for batch in batches:
            for part in chunks(batch, column, limit):
                yield work(part)

    small_batches(df.sparkSession)
    if isinstance(schema, str):
        return df.mapInArrow(run, schema)
    # columns that are kept may have names that mapInArrow does not take
    plain = [c if re.fullmatch(r"\w+", c) else f"column {i}" for i, c in enumerate(df.columns)]
    fields = T.StructType([T.StructField(c, f.dataType, f.nullable) for c, f in zip(plain, schema.fields, strict=True)])
    return df.toDF(*plain).mapInArrow(run, fields).toDF(*df.columns)


def with_text(batch: pa.RecordBatch, text: pa.Array) -> pa.RecordBatch:
    """The batch with this text, and n_chars to match where it has that column."""
    i = batch.schema.get_field_index("text")
    batch = batch.set_column(i, batch.schema.field(i), text.cast(batch.schema.field(i).type))
    if (i := batch.schema.get_field_index("n_chars")) >= 0:
        batch = batch.set_column(i, batch.schema.field(i), pc.utf8_length(text).cast(batch.schema.field(i).type))
    return batch


def strings(column: pa.Array) -> list[str]:
    return column.to_pylist()


def byte_strings(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s:s+l] of each start and length, one after the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
    return values[index]
