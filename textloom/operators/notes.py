"""Notes in order: neighbours that say the same are one run, and only the last runs of each key are kept for a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(notes: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """A row per run of equal values within a key: key, run (from 1), value, n, and the first and last of `order` in it.

    One shuffle by key: the windows and the count share it. order: unique within a key; nulls are a value like any other."""
    w = Window.partitionBy(*key).orderBy(*order)
    before, nth = F.lag(value).over(w), F.row_number().over(w)
    marked = notes.select(*key, *order, value, ((nth == 1) | ~F.col(value).eqNullSafe(before)).cast("long").alias("__new")).withColumn("run", F.sum("__new").over(w))
    place = F.struct(*order)
    return marked.groupBy(*key, "run").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(place).alias("began"), F.max(place).alias("ended"))


def tail(rows: DataFrame, key: list[str], order: str, keep: int) -> DataFrame:
    """The last `keep` rows of each key. Spark limits each task to so many a key before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return rows.withColumn("__nth", nth).filter(F.col("__nth") <= keep).drop("__nth")
