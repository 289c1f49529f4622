"""Packing token sequences by minimum bin slack.

Texts are tokenised once, cut into full windows of CAPACITY ids and one tail. What
packing has to decide then depends on the number of pieces of each length alone: at most
CAPACITY distinct lengths, whatever the input's size. The driver plans over that
histogram. A window takes the longest remaining piece first; a subset-sum dynamic
programme over the multiset of remaining lengths, one bit of a big integer per fill,
finds the fullest completion and is backtracked to counts per length. The pattern so
found is repeated as often as the counts allow. Every repetition leaves some length with
fewer pieces than the pattern needs, so there are at most sum(CAPACITY / length + 1)
patterns, about 18,000 for 2048: the plan that tasks get has a fixed bound.

Pieces meet their slots by rank within their length. Ranks come from counts per (length,
salt), and the number of salts follows that of the most frequent length's pieces, so no
length, however frequent, is numbered in one task.

Defined cases. Null or empty text: the closing id alone. Null doc_id: kept as null.
Repeated rows: packed each on its own. Texts of any length are cut, never dropped. Empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import steps, stored, utf8

CAPACITY = 2048
#: Closes every document.
END_ID = 1
#: Groups of pieces of one length that are numbered apart, at least, and the pieces of a group, about.
SALTS, SALT_PIECES = 256, 1 << 17
#: Words whose ids a worker keeps in each of two generations.
WORDS_KEPT = 300_000

_workers: dict = {}


class Words(dict):
    """The ids of single words as little-endian unsigned 32-bit bytes, kept for the words met lately.

    The vocabulary's normaliser and splitter never look across ASCII white space, so a
    text's ids are its words' ids in order, and each word is encoded once as long as it
    stays in use: when this generation is full it becomes the old one, and words of the old
    one that are met again move back.

    A word of the letters a to z alone is what the normaliser and the splitter make of it,
    one piece of the same bytes, so the merges are asked for it directly.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            if word.isalpha() and word.islower():  # of bytes: ASCII letters
                ids = [t.id for t in self.merges.tokenize(word.decode("ascii"))]
            else:
                ids = self.tokenizer.encode_batch_fast([word.decode("utf-8")], add_special_tokens=False)[0].ids
            found = pack_ids(f"<{len(ids)}I", *ids)
        if len(self) >= WORDS_KEPT:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def ids(self, words: list[bytes]) -> list[bytes]:
        return list(map(self.__getitem__, words))


_ALNUM, _SPACE, _STOP = (np.zeros(256, dtype=bool) for _ in range(3))
_ALNUM[48:58] = _ALNUM[97:123] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP[[44, 46]] = True


def parted(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, list[int]]:
    """The texts with fewer distinct words and the same ids: the vocabulary knows lower case alone, and
    always cuts between a letter or digit and a comma or full stop that ends its word.

    Words keep their case if they hold "<|", as special tokens are the one thing that case matters
    for, or a byte from 0xCC on: the vocabulary composes before it lowers, some capitals compose with
    a mark where their small letters do not or the other way round, and no mark is below U+0300.
    """
    raw = data.tobytes()
    low = np.frombuffer(raw.lower(), dtype=np.uint8)
    kept = data >= 0xCC
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if b"<|" in raw else np.zeros(0, np.int64)
    kept[special] = True
    at = np.flatnonzero(_STOP[low[1:-1]] & _ALNUM[low[:-2]] & _SPACE[low[2:]]) + 1
    if kept.any():
        low = low.copy()
        spaces = np.flatnonzero(_SPACE[data])

        def word(places: np.ndarray) -> np.ndarray:
            return np.searchsorted(spaces, places) + np.searchsorted(offsets, places, side="right")

        marked = np.zeros(len(spaces) + len(offsets) + 1, dtype=bool)
        marked[word(np.flatnonzero(kept))] = True
        capitals = np.flatnonzero(low != data)
        capitals = capitals[marked[word(capitals)]]
        low[capitals] = data[capitals]
        if len(special):
            marked[:] = False
            marked[word(special)] = True
            at = at[~marked[word(at)]]
    # A cut in front of a text's first byte would belong to the text before it.
    at = np.setdiff1d(at, offsets, assume_unique=True)
    return np.insert(low, at, 32).tobytes(), (offsets + np.searchsorted(at, offsets)).tolist()


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and ids, if kept)."""
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep_ids]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    end, width = np.array([END_ID], dtype="<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = Words(path)
        words = _workers[path]
        for batch in steps(batches, "text"):
            data, offsets = parted(*utf8(batch.column(1)))
            rows = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets, offsets[1:], strict=False):
                ids = b"".join(words.ids(data[a:b].split())) + end
                for at in range(0, len(ids), width):
                    piece = ids[at : at + width]
                    rows.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t, _ in zip(zip(*rows, strict=True), kinds, names, strict=False)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_fill(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(length, count) pairs, drawn from the multiset, whose sum is the largest within room."""
    reach, taken, mask = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        left = min(counts[length], room // length)
        part = 1
        while left:
            k = min(part, left)
            grown = (reach | (reach << (k * length))) & mask
            if grown != reach:
                taken.append((length, k, reach))
                reach = grown
            left -= k
            part *= 2
        if reach >> room & 1:
            break
    fill, found = reach.bit_length() - 1, {}
    for length, k, before in reversed(taken):
        if not before >> fill & 1:
            found[length] = found.get(length, 0) + k
            fill -= k * length
    return list(found.items())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repetitions, [(length, count), ...]) patterns that use up the histogram of lengths."""
    counts = {n: c for n, c in histogram.items() if c}
    patterns = []
    while counts:
        lengths = sorted(counts, reverse=True)
        top = lengths[0]
        counts[top] -= 1
        more = best_fill(counts, [n for n in lengths if n <= capacity - top and counts[n]], capacity - top)
        counts[top] += 1
        need = {top: 1}
        for n, k in more:
            need[n] = need.get(n, 0) + k
        times = min(counts[n] // k for n, k in need.items())
        patterns.append((times, sorted(need.items(), reverse=True)))
        for n, k in need.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
    return patterns


def segments(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Per (pattern, length): which ranks of that length go there, and where to."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, parts in patterns:
        offset = 0
        for length, k in parts:
            rank = used.get(length, 0)
            rows.append((length, rank, k, sequence, offset))
            used[length] = rank + times * k
            offset += length * k
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T.copy(), strict=True))


def ranked(pieces: DataFrame, salts: int = SALTS) -> DataFrame:
    """pieces with their rank (from 0) within their length."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    return salted.withColumn("inner", F.row_number().over(inner) - 1).join(offsets, ["length", "salt"]).withColumn("rank", F.col("ahead") + F.col("inner")).drop("salt", "inner", "ahead")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and offset (and ids, little-endian unsigned 32-bit, if kept)."""
    pieces = stored(tokenized(docs, path, capacity, keep_ids), "pack-pieces")
    # At most `capacity` rows, however large the input.
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = segments(plan(histogram, capacity))
    starts = table["length"] * (1 << 42) + table["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(starts, length * (1 << 42) + rank, side="right") - 1
            local = rank - table["rank"][at]
            sequence = table["sequence"][at] + local // table["each"][at]
            offset = table["offset"][at] + local % table["each"][at] * length
            kept = batch.drop_columns(["rank"])
            kept = kept.set_column(kept.schema.get_field_index("length"), "length", pa.array(length))
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    kind = {"ids": "binary"}
    schema = ", ".join(f"{n} {kind.get(n, 'long')}" for n in names) + ", sequence_id long, offset long"
    salts = max(SALTS, max(histogram.values(), default=0) // SALT_PIECES)
    return ranked(pieces, salts).select(*names, F.col("rank").cast("long")).mapInArrow(run, schema)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
