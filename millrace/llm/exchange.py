"""Asking the whole corpus about 64-bit names, a block of documents at a time.

A block is a row that holds some megabytes of documents. What a block wants to know of
the corpus it asks by name: its distinct names, sorted, go out in one payload per bucket
of the name space; the bucket's task sees every block's names of that bucket, works out
an answer for each, and the answers return to the block. Distinct names per block are
the pre-aggregation: a passage that a third of all documents share is one name a block.
The number of buckets follows the corpus, and so does the number of tasks: a task works
through a bucket, or BLOCKS_A_TASK blocks, at a time. A bucket holds BUCKET_NAMES entries
on average; a name that is in every block adds an entry for each of them, one for some
300,000 words of the corpus, which is what a bucket can exceed its share by.

A block sends a payload to each bucket that it has names in. Once there are more buckets
than names in a block, payloads hold single names and their headers outweigh them: for a
corpus of many terabytes raise block_bytes and bucket_names as far as the executors'
memory allows, since a task works on a whole block or a whole bucket at a time.

Payloads are sorted names as 6-byte differences (or 8-byte words where a difference is
larger), which is what keeps the shuffle near the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import steps, stored, utf8

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20
#: Names in a bucket, about.
BUCKET_NAMES = 2 << 20
#: Buckets at least, as a power of two.
LEAST_BITS = 6
#: Blocks of a task, about, and tasks at most.
BLOCKS_A_TASK, TASKS_MOST = 4, 1 << 16

BLOCK_SCHEMA = "block long, ids binary, known binary, offsets binary, data binary, words long"


class Block:
    """One row of blocks(): document ids (known: whether there is one) and their texts as one byte array, compressed while it travels."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.known = np.unpackbits(np.frombuffer(row["known"], dtype=np.uint8), count=len(self.ids)).astype(bool)
        self.offsets = np.frombuffer(row["offsets"], dtype=np.int64)
        self.data = np.frombuffer(pa.decompress(row["data"], int(self.offsets[-1]), codec="zstd", asbytes=True) if self.offsets[-1] else b"", dtype=np.uint8)


def blocks(docs: DataFrame, label: str, count_words: Callable[[np.ndarray, np.ndarray], int], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) as stored blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in steps(batches, "text", block_bytes):
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).fill_null(0).to_numpy().astype(np.int64)
            known = np.packbits(batch.column(0).is_valid().to_numpy(zero_copy_only=False)).tobytes()
            row = [task << 32 | n, ids.tobytes(), known, offsets.astype(np.int64).tobytes(), pa.compress(data.tobytes(), codec="zstd", asbytes=True), count_words(data, offsets)]
            n += 1
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, kinds, strict=True)], names=["block", "ids", "known", "offsets", "data", "words"])

    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCK_SCHEMA), label)


def packed(names: np.ndarray) -> bytes:
    """Sorted distinct names as bytes."""
    steps_ = np.diff(names)
    if len(names) and (not len(steps_) or int(steps_.max()) < 1 << 48):
        return b"\x01" + names[:1].astype("<u8").tobytes() + steps_.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"\x00" + names.astype("<u8").tobytes()


def unpacked(payload: bytes) -> np.ndarray:
    if payload[0] == 0:
        return np.frombuffer(payload, dtype="<u8", offset=1).astype(np.uint64)
    n = (len(payload) - 9) // 6
    wide = np.zeros((n + 1, 8), dtype=np.uint8)
    wide[0] = np.frombuffer(payload, dtype=np.uint8, count=8, offset=1)
    wide[1:, :6] = np.frombuffer(payload, dtype=np.uint8, offset=9).reshape(n, 6)
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64)


def bits_for(names: int, bucket_names: int = BUCKET_NAMES) -> int:
    """The power of two of buckets for about so many names."""
    return max(LEAST_BITS, int(max(1, names) / bucket_names).bit_length())


def dealt(rows: DataFrame, key: str, tasks: int) -> DataFrame:
    """rows dealt by key to so many tasks, where the session's number of shuffle partitions is less."""
    tasks = min(tasks, TASKS_MOST)
    return rows.repartition(tasks, key) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


ASK_SCHEMA = "block long, bucket int, names binary, extra binary"


def asked(block: int, names: np.ndarray, extra: np.ndarray, bits: int) -> pa.RecordBatch:
    """Payload rows for a block's sorted distinct names; extra is an array beside them."""
    cuts = np.searchsorted(names, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    cuts = np.append(cuts, len(names))
    full = np.flatnonzero(np.diff(cuts)).tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block] * len(full), type=pa.int64()),
            pa.array(full, type=pa.int32()),
            pa.array([packed(names[cuts[b] : cuts[b + 1]]) for b in full], type=pa.binary()),
            pa.array([extra[cuts[b] : cuts[b + 1]].tobytes() for b in full], type=pa.binary()),
        ],
        names=["block", "bucket", "names", "extra"],
    )


ANSWER_SCHEMA = "block long, bucket int, answer binary"


def answered(asks: DataFrame, answer: Callable[[np.ndarray, np.ndarray, list[bytes]], np.ndarray], finish: Callable[[np.ndarray], bytes], label: str, bits: int) -> DataFrame:
    """Stored answers (block, bucket, answer) to all asks in 2 ** bits buckets.

    answer gets, for one bucket, all names in sorted order, the order that sorts them, and
    the payloads' extras in their order before sorting; it returns an array in sorted
    order. finish packs one block's share, in the order of its names.
    """

    def run(table: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in table.column("names").to_pylist()]
        sizes = np.array([len(x) for x in parts])
        names = np.concatenate(parts)
        order = np.argsort(names, kind="stable")
        result = answer(names[order], order, table.column("extra").to_pylist())
        back = np.empty(len(result), dtype=result.dtype)
        back[order] = result
        ends = np.cumsum(sizes)
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "answer": pa.array([finish(back[b - a : b]) for a, b in zip(sizes, ends, strict=True)], type=pa.binary())})

    return stored(dealt(asks, "bucket", 1 << bits).groupBy("bucket").applyInArrow(run, ANSWER_SCHEMA), label)


def runs_of(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of every run of equal sorted names."""
    if not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1])
    return first, np.diff(np.append(first, len(names)))


def with_answers(table: DataFrame, answers: DataFrame, use: Callable[[Block, list], Iterator[pa.RecordBatch]], schema: str, n_blocks: int, tagged: bool = False) -> DataFrame:
    """use(block, its answers in bucket order) for every block; tagged: (bucket, answer) pairs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        parts = right.column("answer").to_pylist()
        if tagged:
            parts = list(zip(right.column("bucket").to_pylist(), parts, strict=True))
        found = [b for row in left.to_pylist() for b in use(Block(row), parts)]
        return pa.Table.from_batches(found)

    tasks = n_blocks // BLOCKS_A_TASK
    return dealt(table, "block", tasks).groupBy("block").cogroup(dealt(answers, "block", tasks).groupBy("block")).applyInArrow(run, schema)
