"""Language-model scoring by stupid backoff over n-gram counts of the whole corpus.

The count tables of words, pairs and triples are keyed by 64-bit n-gram names and
partitioned by the names' hash (their leading bits). Each block of documents explodes
its n-grams, asks the tables for the distinct ones among them with its own counts, and
the tables' partitions add those up: what is gathered is every distinct word and pair of
every block, so it grows with the input. The answers are joined back to the block's
n-grams and summed per document. Triples are asked for in a second round, and only where
both of their pairs occur in other documents: no other triple can.

A document is scored against the rest of the corpus: its own occurrences are taken off
every count, so its rare phrases do back off. The score of word w3 after w1 w2, with
counts c, is

    c(w1 w2 w3) / c(w1 w2)   if c(w1 w2 w3) > 0, else
    A * c(w2 w3) / c(w2)     if c(w2 w3) > 0, else
    A * A * max(c(w3), 1/2) / max(N, 1)

with N the other documents' words; the first word of a document starts at the last
line without A, the second at the middle line without its A.

Defined cases. Null or empty text, or white space alone: no words, a null mean.
Null doc_id: kept as null. Repeated rows: each is scored, and sees the others. Only one
document: every word falls to the last line. Empty table: no rows. Other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, scrambled, steps, stored, utf8, window_names, word_names, word_spans
from millrace.llm.exchange import ASK_SCHEMA, BLOCK_BYTES, BUCKET_NAMES, Block, answered, asked, bits_for, blocks, with_answers

ORDER = 3
#: The weight of each step back.
BACKOFF = 0.4


class Grams:
    """A block's words and pairs: names per order, where they start, and the distinct ones of both."""

    def __init__(self, block: Block):
        starts, ends, self.counts = word_spans(block.data, block.offsets)
        self.names = word_names(block.data, starts, ends)
        self.n = len(self.names)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.orders = [window_names(self.names, self.counts, k, salt=10 + k) for k in (1, 2)]
        self.distinct, self.place, self.own = np.unique(np.concatenate([x for x, _ in self.orders]), return_inverse=True, return_counts=True)

    def elsewhere(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By place of the last word: how often that word, and the pair ending there, occur in other documents."""
        one, two = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)
        first = 0
        for k, (names, at) in enumerate(self.orders):
            place = self.place[first : first + len(names)]
            (one, two)[k][at + k] = total[place] - _own(names, self.doc[at])
            first += len(names)
        return one, two

    def triples(self, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names and starts of the triples that may occur in other documents: those both of whose pairs do."""
        names, at = window_names(self.names, self.counts, ORDER, salt=10 + ORDER)
        some = (two[at + 1] > 0) & (two[at + 2] > 0)
        return names[some], at[some]


def _own(names: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each name occurs in its own document."""
    key = scrambled(names + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, own = np.unique(key, return_inverse=True, return_counts=True)
    return own[inverse]


def _asks(block: int, distinct: np.ndarray, own: np.ndarray, bits: int) -> pa.RecordBatch:
    """Names with their counts in the block; the first byte of a bucket's counts tells their width."""
    most = int(own.max()) if len(own) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    batch = asked(block, distinct, own.astype(f"<u{width}"), bits)
    counts = [zlib.compress(bytes([width]) + x, 1) for x in batch.column("extra").to_pylist()]
    return batch.set_column(3, "extra", pa.array(counts, type=pa.binary()))


def _counts(answers: np.ndarray) -> bytes:
    if len(answers) and int(answers.max()) >= 1 << 32:
        return b"L" + answers.astype("<u8").tobytes()
    return zlib.compress(answers.astype("<u4").tobytes(), 1)


def _read(part: bytes) -> np.ndarray:
    if part[:1] == b"L":
        return np.frombuffer(part, dtype="<u8", offset=1).astype(np.int64)
    return np.frombuffer(zlib.decompress(part), dtype="<u4").astype(np.int64)


def _add(names: np.ndarray, order: np.ndarray, extras: list[bytes]) -> np.ndarray:
    """Sums of all blocks' counts of every name."""
    opened = [zlib.decompress(x) for x in extras]
    own = np.concatenate([np.frombuffer(x, dtype=f"<u{x[0]}", offset=1).astype(np.int64) for x in opened])[order]
    first = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1])
    return np.repeat(np.add.reduceat(own, first), np.diff(np.append(first, len(names))))


def _all(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([_read(x) for x in parts]) if parts else np.zeros(0, np.int64)


def scored(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_names: int = BUCKET_NAMES) -> DataFrame:
    """doc_id, n_words, by_triple, by_pair, by_word (words scored at each order) and mean_log_score."""
    table = blocks(docs, "scoring-blocks", lambda data, offsets: int(word_spans(data, offsets)[2].sum()), block_bytes)
    words, n_blocks = table.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count(F.lit(1))).first()
    bits = bits_for(words, bucket_names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = Grams(Block(row))
                yield _asks(row["block"], g.distinct, g.own, bits)

    low = answered(table.mapInArrow(ask, ASK_SCHEMA), _add, _counts, "scoring-pairs", bits)

    def ask_triples(block: Block, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        g = Grams(block)
        names, _ = g.triples(g.elsewhere(_all(parts))[1])
        yield _asks(block.block, *np.unique(names, return_counts=True), bits)

    high = answered(with_answers(table, low, ask_triples, ASK_SCHEMA, n_blocks), _add, _counts, "scoring-triples", bits)
    both = low.select("block", (F.col("bucket") * 2).alias("bucket"), "answer").unionByName(high.select("block", (F.col("bucket") * 2 + 1).alias("bucket"), "answer"))

    def score(block: Block, tagged: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        g = Grams(block)
        one, pair = g.elsewhere(_all([x for b, x in tagged if b % 2 == 0]))
        names, at = g.triples(pair)
        triple = np.zeros(g.n, dtype=np.int64)
        if len(names):
            _, place = np.unique(names, return_inverse=True)
            triple[at + 2] = _all([x for b, x in tagged if b % 2])[place] - _own(names, g.doc[at])
        rest = words - g.counts
        spot = np.arange(g.n) - np.repeat(np.cumsum(g.counts) - g.counts, g.counts)
        ahead, before = np.zeros(g.n, dtype=np.int64), np.zeros(g.n, dtype=np.int64)
        ahead[1:], before[1:] = pair[:-1], one[:-1]
        by3, by2 = triple > 0, (triple <= 0) & (pair > 0)
        steps = np.where(by3, 0, np.where(by2, spot >= 2, np.minimum(spot, 2)))
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(by3, triple / ahead, np.where(by2, pair / before, np.maximum(one, 0.5) / np.maximum(rest[g.doc], 1)))
        logs = np.log(value) + steps * np.log(BACKOFF)
        k = len(g.counts)
        sums = np.bincount(g.doc, weights=logs, minlength=k)
        mean = [None if not n else float(s / n) for s, n in zip(sums, g.counts, strict=True)]
        threes, twos = (np.bincount(g.doc[x], minlength=k) for x in (by3, by2))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(block.ids, mask=~block.known),
                *[pa.array(x.astype(np.int64)) for x in (g.counts, threes, twos, g.counts - threes - twos)],
                pa.array(mean, type=pa.float64()),
            ],
            names=["doc_id", "n_words", "by_triple", "by_pair", "by_word", "mean_log_score"],
        )

    return with_answers(table, both, score, "doc_id long, n_words long, by_triple long, by_pair long, by_word long, mean_log_score double", n_blocks, tagged=True)


def scored_by_rows(docs: DataFrame) -> DataFrame:
    """The same as scored(), with every n-gram a row: count tables by groupBy, joined to the exploded n-grams, summed per document.

    Rows are aggregated per document before they travel. Three rows a word cross the
    network twice, so this takes several times the disk of scored(); README has figures.
    """
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "scoring-rows")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            data, offsets = utf8(batch.column(1))
            starts, ends, counts = word_spans(data, offsets)
            names, ids = word_names(data, starts, ends), batch.column(0).to_numpy()
            doc = np.repeat(np.arange(len(counts)), counts)
            for k in (1, 2, 3):
                grams, at = window_names(names, counts, k, salt=10 + k)
                pairs, own = np.unique(np.stack([doc[at].astype(np.uint64), grams]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[0].astype(np.int64)]), pa.array(pairs[1].view(np.int64)), pa.array(own.astype(np.int64))], names=["row", "gram", "own"])

    grams = rows.select("row", "text").mapInArrow(explode, "row long, gram long, own long")
    totals = grams.groupBy("gram").agg(F.sum("own").alias("total"))
    left = grams.join(totals, "gram").select("row", "gram", (F.col("total") - F.col("own")).alias("left"))
    found = left.groupBy("row").agg(F.collect_list(F.struct("gram", "left")).alias("grams"))
    words = rows.select(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD))), F.lit(0))).first()[0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            out = []
            for doc_id, text, grams in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = np.frombuffer((text or "").encode(), dtype=np.uint8)
                starts, ends, counts = word_spans(data, np.array([0, len(data)]))
                names, c = word_names(data, starts, ends), {g["gram"]: g["left"] for g in grams or ()}
                one, two, three = ([c[g] for g in window_names(names, counts, k, salt=10 + k)[0].view(np.int64).tolist()] for k in (1, 2, 3))
                n, used, logs = len(names), [0, 0, 0], 0.0
                for i in range(n):
                    if i >= 2 and three[i - 2] > 0:
                        used[0] += 1
                        logs += np.log(three[i - 2] / two[i - 2])
                    elif i >= 1 and two[i - 1] > 0:
                        used[1] += 1
                        logs += np.log(two[i - 1] / one[i - 1]) + (i >= 2) * np.log(BACKOFF)
                    else:
                        used[2] += 1
                        logs += np.log(max(one[i], 0.5) / max(words - n, 1)) + min(i, 2) * np.log(BACKOFF)
                out.append((doc_id, n, *used, logs / n if n else None))
            kinds = [*[pa.int64()] * 5, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "by_triple", "by_pair", "by_word", "mean_log_score"])

    joined = rows.join(found, "row", "left").select("doc_id", "text", "grams")
    return joined.mapInArrow(score, "doc_id long, n_words long, by_triple long, by_pair long, by_word long, mean_log_score double")


def op9_scoring(spark, sf_dir: str) -> DataFrame:
    found = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("mean_log_score", F.round("mean_log_score", 6))


OP9_SQL = """
WITH words AS (
  SELECT rid, doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS w
  FROM (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)),
spots AS (
  SELECT rid, i, w AS w3, lag(w, 1) OVER p AS w2, lag(w, 2) OVER p AS w1 FROM words WINDOW p AS (PARTITION BY rid ORDER BY i)),
c1 AS (SELECT w3, count(*) AS c FROM spots GROUP BY w3),
c2 AS (SELECT w2, w3, count(*) AS c FROM spots WHERE i >= 2 GROUP BY w2, w3),
c3 AS (SELECT w1, w2, w3, count(*) AS c FROM spots WHERE i >= 3 GROUP BY w1, w2, w3),
o1 AS (SELECT rid, w3, count(*) AS c FROM spots GROUP BY rid, w3),
o2 AS (SELECT rid, w2, w3, count(*) AS c FROM spots WHERE i >= 2 GROUP BY rid, w2, w3),
o3 AS (SELECT rid, w1, w2, w3, count(*) AS c FROM spots WHERE i >= 3 GROUP BY rid, w1, w2, w3),
l1 AS (SELECT rid, w3, c1.c - o1.c AS c FROM o1 JOIN c1 USING (w3)),
l2 AS (SELECT rid, w2, w3, c2.c - o2.c AS c FROM o2 JOIN c2 USING (w2, w3)),
l3 AS (SELECT rid, w1, w2, w3, c3.c - o3.c AS c FROM o3 JOIN c3 USING (w1, w2, w3)),
sizes AS (SELECT rid, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
total AS (SELECT sum(n) AS n FROM sizes),
found AS (
  SELECT s.rid, s.i, coalesce(t.c, 0) AS triple, coalesce(p.c, 0) AS pair, a.c AS ahead, b.c AS before, u.c AS one
  FROM spots s
  JOIN l1 u ON u.rid = s.rid AND u.w3 = s.w3
  LEFT JOIN l1 b ON b.rid = s.rid AND b.w3 = s.w2
  LEFT JOIN l2 p ON p.rid = s.rid AND p.w2 = s.w2 AND p.w3 = s.w3
  LEFT JOIN l2 a ON a.rid = s.rid AND a.w2 = s.w1 AND a.w3 = s.w2
  LEFT JOIN l3 t ON t.rid = s.rid AND t.w1 = s.w1 AND t.w2 = s.w2 AND t.w3 = s.w3),
logs AS (
  SELECT f.rid, triple > 0 AS by3, triple = 0 AND pair > 0 AS by2,
         CASE WHEN triple > 0 THEN ln(triple::DOUBLE / ahead)
              WHEN pair > 0 THEN ln(pair::DOUBLE / before) + CASE WHEN i >= 3 THEN ln(0.4::DOUBLE) ELSE 0 END
              ELSE ln(greatest(one::DOUBLE, 0.5::DOUBLE) / greatest((SELECT n FROM total) - z.n, 1)) + least(i - 1, 2) * ln(0.4::DOUBLE) END AS x
  FROM found f JOIN sizes z ON z.rid = f.rid),
sums AS (
  SELECT rid, count(*) FILTER (WHERE by3) AS t3, count(*) FILTER (WHERE by2) AS t2, avg(x) AS mean FROM logs GROUP BY rid)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_words, coalesce(t3, 0) AS by_triple, coalesce(t2, 0) AS by_pair,
       CAST(z.n - coalesce(t3, 0) - coalesce(t2, 0) AS BIGINT) AS by_word, round(mean, 6) AS mean_log_score
FROM sizes z LEFT JOIN sums USING (rid)
"""
