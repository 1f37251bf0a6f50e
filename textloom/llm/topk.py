"""Exact top-k search by multi-resolution segment statistics (7).

A vector is cut into segments, each told by its mean and its deviation from it. Two segments
of length l are at least l (m - m')**2 + (d - d')**2 apart (squared), so a few numbers a vector
bound its distance to a query from below; with both norms that bounds the inner product
from above. Bounds are taken coarse to fine, each level for what the one before left; only what is left at the
finest is computed exactly, in whole numbers. A level that has lately turned almost nothing away is passed over.

The threshold of a query starts at its k-th score among a sample of the rows, and within a partition it rises as
candidates pass, so later ones need fewer exact products.

Queries are a stated set against all rows, in blocks of bounded size, one block after the other: a block is
broadcast, every partition keeps its own best k of each query, so what is shuffled is k rows a
query and partition, and its result is written before the next block is read.

Defined results: vectors that are null, empty or hold null or non-finite components take no
part, as query or candidate; vectors of different length are not compared; ties go to the
smaller id; a query's own row (equal id) is no candidate; repeated rows each count; null
ids take no part; query rows that repeat count once; an empty table gives an empty
result. Products that a double cannot hold exactly are computed in Python integers, and a
score is clamped to 64 bits.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_held, files_for, held, held_now, materialise, small_batches

LEVELS = (1, 4, 16, 32, 48)
SAMPLE_ROWS = 4096
_PAIRS = 200_000
_DOUBLE = 2.0**53


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Root length times mean, and deviation (both rows x segments), and the segments' lengths."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    sizes = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    squares = np.add.reduceat(x * x, edges[:-1], axis=1)
    return sums / np.sqrt(sizes), np.sqrt(np.maximum(squares - sums * sums / sizes, 0)), sizes


def upper_bounds(q: tuple, x: tuple) -> np.ndarray:
    """What an inner product can be at most: (|q|^2 + |x|^2 - least squared distance) / 2, which is that of the means plus that of the deviations."""
    return q[0] @ x[0].T + q[1] @ x[1].T


class Block:
    """Queries of one length with their statistics at each level, and a score that the k-th best of each reaches at least."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.levels = [segment_statistics(rows.astype(np.float64), s) for s in LEVELS]
        self.most = float(np.abs(rows.astype(np.float64)).max(initial=0))
        self.least = np.full(len(ids), -np.inf)

    def start_from(self, ids: np.ndarray, rows: np.ndarray, k: int) -> None:
        """Take the k-th score among these rows, which are some of the candidates, as the first threshold."""
        best = Best(len(self.ids), k)
        for at in range(0, len(ids), 1024):
            search_block(self, ids[at : at + 1024], rows[at : at + 1024], best)
        self.least = best.floor()


def _products(q: np.ndarray, x: np.ndarray, safe: bool) -> np.ndarray:
    """Exact inner products of rows in pairs; in doubles where they hold every product."""
    if safe:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    big = (1 << 63) - 1
    return np.array([max(-big - 1, min(big, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for u, v in zip(q, x, strict=True)], np.int64)


class Best:
    """The k best of each query so far, best first, ties to the smaller id; score -inf where there are fewer."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), np.iinfo(np.int64).min, np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.there = np.zeros((n, k), bool)

    def floor(self) -> np.ndarray:
        """The k-th score; anything below cannot enter. -inf as long as there are fewer than k."""
        return np.where(self.there[:, -1], np.nextafter(self.scores[:, -1].astype(np.float64), -np.inf), -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows = np.unique(query)
        place = np.searchsorted(rows, query)
        q = np.r_[place, np.repeat(np.arange(len(rows)), self.k)]
        i, s, t = np.r_[ids, self.ids[rows].ravel()], np.r_[scores, self.scores[rows].ravel()], np.r_[np.ones(len(ids), bool), self.there[rows].ravel()]
        order = np.lexsort((i, ~s, ~t, q))
        q, i, s, t = q[order], i[order], s[order], t[order]
        first = np.searchsorted(q, np.arange(len(rows)))
        take = first[:, None] + np.arange(self.k)
        self.ids[rows], self.scores[rows], self.there[rows] = i[take], s[take], t[take]


class Work:
    """Pairs met, turned away by each level, left as own rows, and computed exactly; they add up."""

    def __init__(self):
        self.pairs = self.own = self.exact = 0
        self.pruned = [0] * len(LEVELS)
        self.lately = [1.0] * len(LEVELS)  # share that a level turned away when it was last used
        self.passed = [0] * len(LEVELS)

    def uses(self, level: int) -> bool:
        """Whether a level is worth its cost; one that is passed over is tried again now and then."""
        if self.lately[level] >= 0.05 or self.passed[level] >= 16:
            self.passed[level] = 0
            return True
        self.passed[level] += 1
        return False


def _pair_bounds(q: tuple, x: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for at in range(0, len(a), _PAIRS):
        i, j = a[at : at + _PAIRS], b[at : at + _PAIRS]
        out[at : at + _PAIRS] = np.einsum("ij,ij->i", q[0][i], x[0][j]) + np.einsum("ij,ij->i", q[1][i], x[1][j])
    return out


def search_block(block: Block, ids: np.ndarray, rows: np.ndarray, best: Best, work: Work | None = None, queries_at_once: int = 256) -> Work:
    """Put the rows' best into `best`; only pairs that no level turns away are multiplied."""
    work = work or Work()
    levels = [segment_statistics(rows.astype(np.float64), s) for s in LEVELS]
    safe = block.most * float(np.abs(rows.astype(np.float64)).max(initial=0)) * rows.shape[1] < _DOUBLE
    slack = 4e-8 * (1 + max((float((x[0] ** 2 + x[1] ** 2).sum(1).max()) for x in (block.levels[0], levels[0])), default=0.0))
    asked, there_rows = (x.astype(np.float64) if safe else x for x in (block.rows, rows))
    for at in range(0, len(block.ids), queries_at_once):
        own = slice(at, at + queries_at_once)
        floor = np.maximum(best.floor(), block.least)[own]
        n = len(floor)
        work.pairs += n * len(ids)
        q = c = None  # all pairs, as long as no level has been used
        for k, there in enumerate(levels):
            if not work.uses(k):
                continue
            here = tuple(x[own] for x in block.levels[k][:2])
            if q is None:
                before = n * len(ids)
                q, c = np.nonzero(upper_bounds(here, there) >= (floor - slack)[:, None])
            else:
                before = len(q)
                # bounds of many pairs come cheaper from one product of the statistics
                bound = upper_bounds(here, there)[q, c] if 40 * len(q) > n * len(ids) else _pair_bounds(here, there, q, c)
                left = bound >= floor[q] - slack
                q, c = q[left], c[left]
            work.pruned[k] += before - len(q)
            if np.isfinite(floor).all():  # without a threshold nothing could be turned away
                work.lately[k] = 1 - len(q) / max(1, before)
            if not len(q):
                break
        if q is None:
            q, c = np.repeat(np.arange(n), len(ids)), np.tile(np.arange(len(ids)), n)
        other = block.ids[own][q] != ids[c]
        work.own += len(q) - int(other.sum())
        q, c = q[other], c[other]
        work.exact += len(q)
        for i in range(0, len(q), _PAIRS):
            a, b = q[i : i + _PAIRS], c[i : i + _PAIRS]
            scores = _products(asked[own][a], there_rows[b], safe)
            enters = scores >= floor[a]
            if enters.any():
                best.add(at + a[enters], ids[b][enters], scores[enters])
    return work


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _usable(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """id, len, row: vectors that take part, components scaled and floored to 64-bit integers (saturating)."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    limit = float(1 << 62)
    whole = F.transform(
        v,
        lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(F.least(F.greatest(x * scale, F.lit(-limit)), F.lit(limit))).cast("double"))).cast("long")
    )
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).filter(F.size(vector) > 0).filter(~bad)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.size(vector).alias("len"), whole.alias("row"))


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for n in sorted(set(table["len"].to_pylist())):
        own = table.filter(pc.equal(table["len"], n))
        out[n] = own["id"].to_numpy(), _matrix(own["row"].combine_chunks(), n)
    return out


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256,
    block_rows: int = 16_384
) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer inner products of each query with the other rows.

    Queries are read in blocks of about half of block_rows by their hash, one block at a time, so the driver holds one; each makes one pass over the vectors."""
    small_batches(vectors.sparkSession)
    before = held_now()
    asked, rows = held(_usable(queries, id_col, vector, scale).distinct()), _usable(vectors, id_col, vector, scale)
    spark, parts = vectors.sparkSession, []
    blocks = max(1, -(-asked.count() // max(1, block_rows // 2)))
    sample = _by_length(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow())
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for b in range(blocks):
        of_length = {n: Block(*x) for n, x in _by_length(asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()).items()}
        for n, block in of_length.items():
            if n in sample:
                block.start_from(*sample[n], k)
        if of_length:
            sent = spark.sparkContext.broadcast(of_length)
            found = rows.mapInArrow(functools.partial(_best_of_partition, sent, k), "query_id long, vec_id long, score long")
            top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            parts.append(materialise(top, "top", files_for(k * block_rows)))
            sent.destroy()
    drop_held(before)
    return functools.reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _best_of_partition(sent, k: int, batches):
    blocks = sent.value
    best, work = {n: Best(len(b.ids), k) for n, b in blocks.items()}, {n: Work() for n in blocks}
    for batch in batches:
        lengths = batch.column("len").to_numpy()
        for n in np.unique(lengths).tolist():
            if n in blocks:
                own = batch.filter(pa.array(lengths == n))
                for at in range(0, own.num_rows, 4096):
                    part = own.slice(at, 4096)
                    search_block(blocks[n], part.column("id").to_numpy(), _matrix(part.column("row"), n), best[n], work[n])
    for n, b in blocks.items():
        q, j = np.nonzero(best[n].there)
        yield pa.RecordBatch.from_arrays([pa.array(b.ids[q]), pa.array(best[n].ids[q, j]), pa.array(best[n].scores[q, j])], ["query_id", "vec_id", "score"])
