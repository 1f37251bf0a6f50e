"""Packing (1): first-fit decreasing with a tournament tree, in randomised groups.

Documents are tokenised and cut into pieces of `length` ids and a rest. Each piece goes
to a group by a hash of its row's place in the input and its own place in the document, whatever the ids are, so groups are alike; a hot source, a huge
document, rows without an id and rows of one id are spread over all of them, and there are as many as the bytes of text ask for.
A task that is run again must meet its rows in the same order, as it does on files; cut the lineage of anything else first. A group is packed by
itself: pieces from the longest to the shortest, each into the first sequence with room;
a tree of the greatest room left under each node finds that sequence in logarithmic time.

Padding fills a sequence to `length`, unless it is already at a power of two.

Defined results: null text is empty; an empty text is its end id alone; ties in length are
packed by doc_id, then place (null doc_id last); rows that repeat are packed each; an
empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_chunks, text_of
from .tokens import shared_coder

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, place long"
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_GROUP_BITS = 24


class RoomTree:
    """A tournament of bins: each node holds the greatest room left below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, math.ceil(math.log2(max(1, bins))))
        self.room = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """The first bin with room for size, and the room it had."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had = room[at]
        room[at] = had - size
        leaf, at = at - self.leaves, at >> 1
        while at:
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
            at >>= 1
        return leaf, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each size; sizes come in descending order."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    whole = int((sizes == capacity).sum())
    bins[:whole], offsets[:whole] = np.arange(whole), 0
    rest = sizes[whole:].tolist()
    tree = RoomTree(len(rest), capacity)
    for i, size in enumerate(rest, whole):
        leaf, had = tree.take(size)
        bins[i], offsets[i] = whole + leaf, capacity - had
    return bins, offsets


def cut(tokens: np.ndarray, counts: np.ndarray, length: int):
    """Pieces of the documents' ids, one after the other: document, start and length of each."""
    per = -(-counts // length)
    doc = np.repeat(np.arange(len(counts)), per)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * length
    return doc, start, np.minimum(counts[doc] - start, length)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (two bytes an id, four where the vocabulary needs them) and the row's place in the input, no shuffle."""

    def make():
        coder = shared_coder(tokenizer, end_id)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, counts = coder.encode(batch.column("text"))
            doc, start, size = cut(ids, counts, length)
            ends = np.r_[0, np.cumsum(size)] * ids.dtype.itemsize
            blob = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(counts[doc]), blob, batch.column("place").take(pa.array(doc))],
                [x.split()[0] for x in PIECES.split(", ")]
            )

        return work

    return map_chunks(docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.monotonically_increasing_id().alias("place")), "text", make, PIECES)


def _pack_group(table: pa.Table, length: int) -> pa.Table:
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("place", "ascending")])
    sizes = table["length"].to_numpy()
    bins, offsets = first_fit_decreasing(sizes, length)
    ids = []
    for size, x in zip(sizes.tolist(), table["ids"].to_pylist(), strict=True):
        ids.append(x if len(x) == 4 * size else np.frombuffer(x, "<u2").astype("<u4").tobytes())
    group = table["grp"][0].as_py()
    columns = [
        table["doc_id"], table["start"], table["length"], table["doc_tokens"], pa.array((group << _GROUP_BITS) + bins),
        pa.array(offsets), pa.array(ids, pa.binary())
    ]
    return pa.Table.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, group_bytes: int = 8 << 20) -> DataFrame:
    """A row per piece with its sequence, its offset there and its ids (unsigned little-endian 32-bit)."""
    total = docs.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    pieces = token_pieces(docs, tokenizer, end_id, length)
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("place", "start"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(lambda table: _pack_group(table, length), SCHEMA)


def padding(sequence_tokens: int, length: int = 2048) -> int:
    """The ids that fill a sequence up."""
    return 0 if sequence_tokens and sequence_tokens & (sequence_tokens - 1) == 0 else length - sequence_tokens
