"""Substring dedup by recompression.

The words of a document are its first sequence of symbols. Each of ROUNDS rounds makes a
shorter one: runs of equal symbols become one symbol, named after the symbol and the
run's length; then pairs become one symbol whose left part is of class L and whose right
part is of class R, where the class is a bit of the name. A name is a 64-bit hash of what
it stands for, so it is the same in every task and every document: names are agreed
globally without a dictionary that tasks would have to share.

A symbol knows its context: the words that fix that it is there. A run needs its two
neighbours, a pair its two runs, a run that stays alone the neighbour that it might have
joined; the start and the end of a document are no context that another place could
share. A symbol whose context lies within a window is sure: wherever the window's words
occur, so does the symbol, at the same offset. The key of a window is the least name
among triples of neighbouring sure symbols (or, where fewer are sure, of the pair or the
single one); equal windows have equal keys. A window without a sure symbol (in a long run
of one word, or next to a document's end) has its own name as key.

Spark rounds: (A) every block asks which of its keys other blocks have too; (B) the
windows whose key occurs again, there or within the block, are asked for by their full
names, with the least doc_id that has them; (C) a window that a smaller doc_id has covers
its words. Windows that no other place shares never leave their block, but as one key for
several windows. Nothing is sampled: the keys of two equal windows are equal, so (A) loses
none of them, and (B) compares whole windows, by 95 bits of two independent hashes of
their words, so unlike windows do not meet at any realistic size.

Defined cases. Null or empty text: no words, the hash of the empty string. Fewer words
than a window: nothing is removed. Null doc_id: counts as larger than any other, covers
nothing, and is returned as null. Repeated rows, equal doc_id: neither is smaller, so
neither covers the other. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import scrambled, window_names, word_names, word_spans
from millrace.llm.exchange import ASK_SCHEMA, BLOCK_BYTES, BUCKET_NAMES, Block, answered, asked, bits_for, blocks, runs_of, with_answers

WINDOW = 13
#: Rounds of run and pair naming; the context of a symbol of the second has 12 words at most, but for runs.
ROUNDS = 2
#: Neighbouring sure symbols that a key is named after, and the symbols that a window can hold.
TOGETHER = 3
#: Larger than any doc_id's place among known ones; null ids have it.
_LAST = np.iinfo(np.int64).max
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _class_left(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(17)) & np.uint64(1) == 0


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return scrambled(left * np.uint64(3) + right)


@dataclass(frozen=True)
class Symbols:
    """A sequence of symbols of many documents: their names, documents, and contexts [low, high) in words."""

    names: np.ndarray
    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a symbol follows another one of its document, and whether one of its document follows it."""
        joined = self.doc[1:] == self.doc[:-1]
        return np.concatenate([[False], joined]), np.concatenate([joined, [False]])

    def runs(self, outside: tuple[np.ndarray, np.ndarray]) -> Symbols:
        """Every run of equal symbols as one; outside is a word before and one after each document."""
        after, _ = self.neighbours()
        first = np.flatnonzero(~after | np.concatenate([[True], self.names[1:] != self.names[:-1]]))
        last = np.append(first[1:], len(self.names)) - 1
        length = last - first + 1
        names = np.where(length > 1, scrambled(self.names[first] + length.astype(np.uint64) * _GOLDEN), self.names[first])
        doc = self.doc[first]
        before, behind = self.neighbours()
        low = np.where(before[first], self.low[first - 1], outside[0][doc])
        high = np.where(behind[last], self.high[np.minimum(last + 1, len(self.names) - 1)], outside[1][doc])
        return Symbols(names, doc, low, high)

    def pairs(self, outside: tuple[np.ndarray, np.ndarray]) -> Symbols:
        """Every pair of a symbol of class L and one of class R as one."""
        before, behind = self.neighbours()
        left = _class_left(self.names)
        opens = np.zeros(len(left), dtype=bool)
        opens[:-1] = left[:-1] & ~left[1:] & behind[:-1]
        stays = ~np.concatenate([[False], opens[:-1]])
        names = scrambled(self.names)
        names[opens] = _pair(self.names[opens], self.names[np.flatnonzero(opens) + 1])
        # One of class L has looked at what follows, one of class R that stays alone at what precedes.
        high = np.where(left, np.where(behind, np.append(self.high[1:], 0), outside[1][self.doc]), self.high)
        low = np.where(left, self.low, np.where(before, np.concatenate([[0], self.low[:-1]]), outside[0][self.doc]))
        return Symbols(names[stays], self.doc[stays], low[stays], high[stays])


def recompressed(names: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    """The symbols of the documents' words, with counts words each, after so many rounds."""
    ends = np.cumsum(counts)
    outside = (ends - counts - 1, ends + 1)
    at = np.arange(len(names))
    found = Symbols(names, np.repeat(np.arange(len(counts)), counts), at, at + 1)
    for _ in range(rounds if len(names) else 0):
        found = found.runs(outside).pairs(outside)
    return found


def window_keys(names: np.ndarray, counts: np.ndarray, full: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The key of every window that starts at one of `at` and is named one of `full`."""
    if not len(at):
        return full
    found = recompressed(names, counts)
    # Contexts start and end in the order of their symbols, so a window's sure symbols are neighbours.
    first = np.searchsorted(found.low, at, side="left")
    sure = np.searchsorted(found.high, at + WINDOW, side="right") - first
    level, keys = found.names, full.copy()
    for wide in range(1, TOGETHER + 1):
        if wide > 1:
            level = _pair(level[:-1], found.names[wide - 1 :])
        some = np.flatnonzero(sure == wide if wide < TOGETHER else sure >= wide)
        if not len(some):
            continue
        least = level[first[some]]
        for step in range(1, int(sure[some].max()) - wide + 1):
            more = sure[some] >= wide + step
            least[more] = np.minimum(least[more], level[first[some[more]] + step])
        keys[some] = scrambled(least + np.uint64(wide))
    return keys


class Windows:
    """The windows of a block: their full names, their keys and where they start."""

    def __init__(self, block: Block):
        self.block = block
        self.starts, self.ends, self.counts = word_spans(block.data, block.offsets)
        self.names = word_names(block.data, self.starts, self.ends)
        self.full, self.at = window_names(self.names, self.counts, WINDOW)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)[self.at]
        self.symbol = window_keys(self.names, self.counts, self.full, self.at)


def _bit(answers: np.ndarray) -> bytes:
    return np.packbits(answers).tobytes()


def _joined(parts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The answers of all buckets, in the order of the names."""
    if not len(sizes):
        return np.zeros(0, dtype=bool)
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)) for x, n in zip(parts, sizes, strict=True)]).astype(bool)


def _sizes(names: np.ndarray, bits: int) -> np.ndarray:
    """Names per bucket that has any."""
    return np.unique(names >> np.uint64(64 - bits), return_counts=True)[1]


def _again(w: Windows, parts: list[bytes], bits: int) -> np.ndarray:
    """Indices of the windows whose symbol occurs again."""
    symbols, place = np.unique(w.symbol, return_inverse=True)
    elsewhere = _joined(parts, _sizes(symbols, bits))
    # Windows of two documents start at least WINDOW words apart.
    first = np.full(len(symbols), np.iinfo(np.int64).max)
    last = np.zeros(len(symbols), dtype=np.int64)
    np.minimum.at(first, place, w.at)
    np.maximum.at(last, place, w.at)
    return np.flatnonzero((elsewhere | (last - first >= WINDOW))[place])


@dataclass(frozen=True)
class Candidates:
    """The windows of a block whose key occurs again, and what is asked about their distinct full names."""

    chosen: np.ndarray
    distinct: np.ndarray
    place: np.ndarray  # of each chosen window among the distinct ones
    least: np.ndarray  # the least known doc_id here that has the window
    known: np.ndarray  # whether any known doc_id has it

    @classmethod
    def of(cls, w: Windows, parts: list[bytes], bits: int) -> Candidates:
        chosen = _again(w, parts, bits)
        distinct, place = np.unique(w.full[chosen], return_inverse=True)
        least, known = np.full(len(distinct), _LAST, dtype=np.int64), np.zeros(len(distinct), dtype=bool)
        some = w.block.known[w.doc[chosen]]
        np.minimum.at(least, place[some], w.block.ids[w.doc[chosen[some]]])
        known[place[some]] = True
        return cls(chosen, distinct, place, least, known)

    def covered(self, w: Windows, earlier: np.ndarray) -> np.ndarray:
        """The chosen windows that a smaller doc_id has; earlier tells which names one of another block has."""
        doc = w.doc[self.chosen]
        here = np.where(w.block.known[doc], w.block.ids[doc] > self.least[self.place], self.known[self.place])
        return self.chosen[earlier[self.place] | here]


def removed(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_names: int = BUCKET_NAMES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (its remaining words joined by one space)."""
    table = blocks(docs, "recompression-blocks", lambda data, offsets: int(word_spans(data, offsets)[2].sum()), block_bytes)
    words, n_blocks = table.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count(F.lit(1))).first()
    bits = bits_for(words // 2, bucket_names)

    def ask_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = Windows(Block(row))
                names = np.unique(w.symbol)
                yield asked(w.block.block, names, np.zeros(len(names), dtype="V0"), bits)

    def in_two(names: np.ndarray, order: np.ndarray, extras: list[bytes]) -> np.ndarray:
        _, lengths = runs_of(names)
        return np.repeat(lengths > 1, lengths)

    shared = answered(table.mapInArrow(ask_symbols, ASK_SCHEMA), in_two, _bit, "recompression-symbols", bits)

    def ask_windows(block: Block, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        w = Windows(block)
        c = Candidates.of(w, parts, bits)
        check = np.zeros(len(c.distinct), dtype=np.uint64)
        if len(c.chosen):
            other, _ = window_names(w.names, w.counts, WINDOW, salt=2)
            check[c.place] = scrambled(other[c.chosen] ^ w.full[c.chosen])
        extra = np.empty(len(c.distinct), dtype=[("doc", "<i8"), ("check", "<u4")])
        # The lowest bit tells whether the doc_id is known.
        extra["doc"], extra["check"] = c.least, (check >> np.uint64(33)).astype(np.uint32) << np.uint32(1) | c.known
        yield asked(block.block, c.distinct, extra, bits)

    def has_smaller(names: np.ndarray, order: np.ndarray, extras: list[bytes]) -> np.ndarray:
        extra = np.frombuffer(b"".join(extras), dtype=[("doc", "<i8"), ("check", "<u4")])[order]
        key = np.lexsort((extra["check"] >> np.uint32(1), names))
        name, check, doc = names[key], extra["check"][key] >> np.uint32(1), extra["doc"][key]
        known = (extra["check"][key] & np.uint32(1)).astype(bool)
        fresh = np.ones(len(name), dtype=bool)
        fresh[1:] = (name[1:] != name[:-1]) | (check[1:] != check[:-1])
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(doc)))
        least = np.repeat(np.minimum.reduceat(doc, first), size)  # unknown ones are _LAST, the largest
        some = np.repeat(np.logical_or.reduceat(known, first), size)
        out = np.empty(len(names), dtype=bool)
        out[key] = np.where(known, least < doc, some)
        return out

    smaller = answered(with_answers(table, shared, ask_windows, ASK_SCHEMA, n_blocks), has_smaller, _bit, "recompression-windows", bits)
    both = shared.select("block", (F.col("bucket") * 2).alias("bucket"), "answer").unionByName(smaller.select("block", (F.col("bucket") * 2 + 1).alias("bucket"), "answer"))

    def cover(block: Block, tagged: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        w = Windows(block)
        c = Candidates.of(w, [x for b, x in tagged if b % 2 == 0], bits)
        hit = c.covered(w, _joined([x for b, x in tagged if b % 2], _sizes(c.distinct, bits))) if len(c.chosen) else c.chosen
        edge = np.zeros(len(w.starts) + 1, dtype=np.int64)
        np.add.at(edge, w.at[hit], 1)
        np.add.at(edge, w.at[hit] + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
        data, rows, first = block.data.tobytes(), [], 0
        starts, ends = w.starts.tolist(), w.ends.tolist()
        for i, n in enumerate(w.counts.tolist()):
            lost = gone[first : first + n]
            kept = b" ".join([data[a:b] for a, b, x in zip(starts[first : first + n], ends[first : first + n], lost.tolist(), strict=True) if not x])
            rows.append((int(block.ids[i]) if block.known[i] else None, n, int(lost.sum()), kept.decode("utf-8")))
            first += n
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    return with_answers(table, both, cover, "doc_id long, n_words long, n_removed long, kept string", n_blocks, tagged=True)


def op10_recompression(spark, sf_dir: str) -> DataFrame:
    found = removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))



OP10_SQL = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs),
windows AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM starts),
least AS (SELECT g, min(doc_id) AS m FROM windows GROUP BY g),
hit AS (SELECT rid, i FROM windows JOIN least USING (g) WHERE m < doc_id OR (doc_id IS NULL AND m IS NOT NULL)),
gone AS (SELECT DISTINCT rid, i FROM (SELECT rid, unnest(range(i, i + 13)) AS i FROM hit)),
words AS (SELECT rid, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM docs),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (rid)
"""
