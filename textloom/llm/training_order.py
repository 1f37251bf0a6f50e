"""Token ids in training order (2): a keyed Feistel permutation deals sequences to slots.

Each partition's ids, documents one after the other with an id at each end, are cut into
sequences of `length`; sequences are numbered without gaps from the partitions' counts, and a
keyed Feistel network over the next power of four, walked on until the slot is below the count,
gives each its global slot. Slots go in ranges to shards; a shard is one
file of fixed-stride records (count of ids, then `length` ids), so any slot is found by
arithmetic and a reader can stop and go on anywhere (`read_from`). A shard is written under another name and moved onto its own, in place of what a task that
was lost after its move has left there, so a task that runs twice leaves one whole file.

Numbers are reproducible for the same input files and partitioning. The tokens are
written once to the shared folder before numbering, packed with zstd.

Defined results: null text is empty, an empty text is its end id alone; a partition's last
sequence may be shorter and is padded with `pad_id`; rows that repeat are each written; an
empty table gives no shards and an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialise, new_path, release, small_batches, text_of
from .tokens import WordTokens, shared_coder

_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def feistel_slots(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0..n-1 told by key, of the given numbers."""
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    x = index.astype(np.uint64)
    left_to_walk = np.ones(len(x), bool)
    while left_to_walk.any():
        own = x[left_to_walk]
        a, b = own >> half, own & mask
        for r in range(rounds):
            a, b = b, a ^ (_round(b, key * 0x100000001B3 + r * 0x632BE59BD9B4E019) & mask)
        x[left_to_walk] = (a << half) | b
        left_to_walk[left_to_walk] = x[left_to_walk] >= n
    return x.astype(np.int64)


SEQUENCES = "part int, nth long, n int, blob binary, doc_id array<long>, start array<long>, length array<int>"


def token_sequences(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """Sequences of a partition in order, with the stretches of documents in each."""

    def run(batches):
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        coder = shared_coder(tokenizer, end_id)
        pack = zstandard.ZstdCompressor(level=3)
        held, docs_held = np.empty(0, coder.dtype), []  # ids that fill no sequence yet; (doc, start, count)

        def out(ids, spans, rows):
            nonlocal nth
            rows.append((part, nth, len(ids), pack.compress(np.ascontiguousarray(ids).tobytes()), *map(list, zip(*spans, strict=True))))
            nth += 1

        def batch_of(rows):
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["part", "nth", "n", "blob", "doc_id", "start", "length"])

        for batch in batches:
            for chunk in chunks(batch, "text"):
                ids, counts = coder.encode(chunk.column("text"))
                held = np.concatenate([held, ids])
                docs_held += [[d, 0, int(c)] for d, c in zip(chunk.column("doc_id").to_pylist(), counts, strict=True)]
                rows, at, d = [], 0, 0
                while at + length <= len(held):
                    spans, need = [], length
                    while need:
                        doc, start, left = docs_held[d]
                        got = min(left, need)
                        spans.append((doc, start, got))
                        docs_held[d] = [doc, start + got, left - got]
                        need -= got
                        d += left == got
                    out(held[at : at + length], spans, rows)
                    at += length
                held, docs_held = held[at:].copy(), docs_held[d:]
                if rows:
                    yield batch_of(rows)
        if len(held):
            rows = []
            out(held, [tuple(x) for x in docs_held if x[2]], rows)
            yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, SEQUENCES)


def _files(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path and the path in it. Hadoop's names of object stores are theirs here too."""
    for given, known in (("s3a://", "s3://"), ("s3n://", "s3://"), ("abfss://", "abfs://")):
        if path.startswith(given):
            path = known + path.removeprefix(given)
    return pa.fs.FileSystem.from_uri(path)


def _publish(files: pa.fs.FileSystem, written: str, name: str) -> None:
    """Move a whole shard onto its name. A shard that is there already is of a task that was lost after its move, and holds the same records."""
    if files.get_file_info(name).type != pa.fs.FileType.NotFound:
        files.delete_file(name)
    files.move(written, name)


SHARDS_A_TASK = 8  # of 17 MB each with the default record and shard
INDEX = "slot long, shard long, n int, doc_id array<long>, start array<long>, length array<int>"


def write_training_order(
    docs: DataFrame, tokenizer: str, path: str, key: int = 20_240_601, end_id: int = 1, pad_id: int = 0, length: int = 2048,
    shard_records: int = 4096
) -> DataFrame:
    """Write shards under path; returns the index: slot, shard, ids in use, and the documents' stretches."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = materialise(token_sequences(docs, tokenizer, end_id, length), "sequences")
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    begins, total = {}, 0
    for part in sorted(counts):
        begins[part] = total
        total += counts[part]
    size = WordTokens(tokenizer, end_id).dtype.itemsize
    sent = spark.sparkContext.broadcast(begins)

    def number(batches):
        for batch in batches:
            index = np.array([sent.value[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("nth").to_numpy()
            slot = feistel_slots(index, total, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(slot // shard_records), *(batch.column(x) for x in ("n", "doc_id", "start", "length", "blob"))],
                ["slot", "shard", "n", "doc_id", "start", "length", "blob"]
            )

    def write(batches):
        files, folder = _files(path)
        unpack = zstandard.ZstdDecompressor()
        shard, stream, names, expected = None, None, None, 0

        def close():
            if stream is not None:
                stream.close()
                _publish(files, *names)

        for batch in batches:
            slots, shards, n, blobs = (batch.column(x).to_pylist() for x in ("slot", "shard", "n", "blob"))
            for s, h, k, blob in zip(slots, shards, n, blobs, strict=True):
                if h != shard:
                    close()
                    from pyspark import TaskContext

                    shard, names, expected = h, (f"{folder}/_{h:08d}-{TaskContext.get().taskAttemptId()}", f"{folder}/shard-{h:08d}.bin"), h * shard_records
                    files.create_dir(folder, recursive=True)
                    stream = files.open_output_stream(names[0])
                if s != expected:
                    raise ValueError(f"slot {s} where {expected} was due")
                expected += 1
                ids = np.full(length, pad_id, "<u2" if size == 2 else "<u4")
                ids[:k] = np.frombuffer(unpack.decompress(blob, max_output_size=length * size), ids.dtype)
                stream.write(np.array([k], "<u4").tobytes() + ids.tobytes())
            yield batch.select(["slot", "shard", "n", "doc_id", "start", "length"])
        close()

    shards = max(1, -(-total // shard_records))
    # which range of shards a task writes is known, so none is found by sampling
    each = min(SHARDS_A_TASK, max(1, shards // 1000))
    tasks = -(-shards // each)
    ranged = rows.mapInArrow(number, f"{INDEX}, blob binary").repartitionById(tasks, F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("slot")
    index = materialise(ranged.mapInArrow(write, INDEX), "index")
    release(rows)
    return index


PIECES = "doc_id long, start long, length long, slot long, shard long, offset long, ids_crc32 long"


def read_pieces(index: DataFrame, path: str, length: int = 2048, width: int = 2, shard_records: int = 4096) -> DataFrame:
    """A row per stretch of a document, its ids read back from the shard at its slot's place."""
    stride = 4 + length * width

    def run(batches):
        files, folder = _files(path)
        shard, stream = None, None
        for batch in batches:
            rows = []
            for slot, h, n, docs, starts, sizes in zip(*(batch.column(x).to_pylist() for x in ("slot", "shard", "n", "doc_id", "start", "length")), strict=True):
                if h != shard:
                    if stream is not None:
                        stream.close()
                    shard, stream = h, files.open_input_file(f"{folder}/shard-{h:08d}.bin")
                record = stream.read_at(stride, (slot - h * shard_records) * stride)
                if int.from_bytes(record[:4], "little") != n:
                    raise ValueError(f"the record of slot {slot} does not hold what the index says")
                ids, at = np.frombuffer(record, f"<u{width}", offset=4).astype("<u4"), 0
                for d, s, k in zip(docs, starts, sizes, strict=True):
                    rows.append((d, s, k, slot, h, at, zlib.crc32(ids[at : at + k].tobytes())))
                    at += k
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(7)], [x.split()[0] for x in PIECES.split(", ")])
        if stream is not None:
            stream.close()

    return index.mapInArrow(run, PIECES)


def read_from(spark: SparkSession, path: str, first: int, count: int, length: int = 2048, width: int = 2, shard_records: int = 4096) -> DataFrame:
    """slot, n and ids (little-endian, without padding) of `count` sequences from slot `first` on, over shard borders: what a training run reads when it goes on.

    A task reads its shard's records one after the other from the first that is wanted; slots after the last there is have no row."""
    stride = 4 + length * width
    shards = range(first // shard_records, (first + max(count, 1) - 1) // shard_records + 1)

    def run(batches):
        files, folder = _files(path)
        for batch in batches:
            for h in batch.column("id").to_pylist():
                name, begin = f"{folder}/shard-{h:08d}.bin", max(first, h * shard_records)
                if files.get_file_info(name).type == pa.fs.FileType.NotFound:
                    continue
                with files.open_input_file(name) as stream:
                    stream.seek((begin - h * shard_records) * stride)
                    for slot in range(begin, min(first + count, (h + 1) * shard_records), 64):
                        held = stream.read(stride * min(64, min(first + count, (h + 1) * shard_records) - slot))
                        sizes = [int.from_bytes(held[i : i + 4], "little") for i in range(0, len(held), stride)]
                        if sizes:
                            ids = [held[i * stride + 4 : i * stride + 4 + n * width] for i, n in enumerate(sizes)]
                            yield pa.RecordBatch.from_arrays([pa.array(range(slot, slot + len(sizes)), pa.int64()), pa.array(sizes, pa.int32()), pa.array(ids, pa.binary())], ["slot", "n", "ids"])

    return spark.range(shards.start, shards.stop, 1, max(1, len(shards))).mapInArrow(run, "slot long, n int, ids binary")


def training_order(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the documents in training order to the shared folder and read every stretch back."""
    path = new_path(docs.sparkSession, "shards")
    width = WordTokens(tokenizer, options.get("end_id", 1)).dtype.itemsize
    index = write_training_order(docs, tokenizer, path, **options)
    return read_pieces(index, path, options.get("length", 2048), width, options.get("shard_records", 4096))
