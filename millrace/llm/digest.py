"""Document fingerprints: a quartile bucket digest of byte triplets.

Every byte of a text starts one triplet (two zero bytes close the text). Triplets are
hashed into BUCKETS counters; a counter's code is how many of the document's quartiles it
exceeds, 0 to 3. The digest is a byte for the length, on a logarithmic scale, then the
codes, four to a byte, in hexadecimal: 258 characters for a text of any size. The
difference of two digests adds up the codes' differences and a bounded term for the
lengths; likeness is 1 less that sum over what unrelated codes would give, from 0 to 1.

Neighbours in the order of doc_id meet without a global sort in one task: ranges of
doc_id, cut at approximate quantiles, are sorted apart, and the first row of each range
is also dealt to the range before it. Texts are shuffled once. Rows of one doc_id, or of
none, are in the order of their texts' XXH64, so that an id which is several quantiles at
once, and the null ids, are cut into ranges of that hash.

Defined cases. Null or empty text: no triplets, all codes 0, length 0; two such are alike
at 1.0. Null doc_id: after all others. Null or repeated doc_ids among themselves: by the
text's XXH64, then by text. A single row is its own next. Long texts are counted whole, in
parts. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 512
#: Mean difference of two independent codes that are uniform over 0 to 3.
UNRELATED = 1.25
#: Steps of the length byte to a doubling; most that differing lengths count, in steps.
LENGTH_STEPS, LENGTH_MOST = 8, 32
#: Bytes of text that are counted at a time.
PART_BYTES = 1 << 20
#: Rows of a doc_id range, about, and ranges at most.
RANGE_ROWS, RANGES_MOST = 4096, 1 << 16


def codes(texts: list[bytes]) -> np.ndarray:
    """Per text its length byte and its BUCKETS codes."""
    out = np.zeros((len(texts), 1 + BUCKETS), dtype=np.uint8)
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= PART_BYTES):
            size += len(texts[to])
            to += 1
        if size > PART_BYTES:  # one long text
            counts, lengths = long_counts(texts[at])[None, :], np.array([size])
            out[at:to] = coded(counts, lengths)
            at = to
            continue
        part = texts[at:to]
        data = np.frombuffer(b"\0\0".join(part) + b"\0\0", dtype=np.uint8).astype(np.uint32)
        lengths = np.array([len(t) for t in part])
        keep = np.ones(len(data), dtype=bool)
        closing = np.cumsum(lengths + 2)
        keep[closing - 1] = keep[closing - 2] = False
        bucket = buckets(data)[keep[:-2]]
        doc = np.repeat(np.arange(len(part)), lengths)
        counts = np.bincount(doc * BUCKETS + bucket, minlength=len(part) * BUCKETS).reshape(len(part), BUCKETS)
        out[at:to] = coded(counts, lengths)
        at = to
    return out


def buckets(data: np.ndarray) -> np.ndarray:
    """The counter of the triplet that each byte but the last two starts."""
    triplet = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return (triplet * np.uint32(2654435761)) >> np.uint32(32 - 9)


def long_counts(text: bytes) -> np.ndarray:
    """The counters of one text, PART_BYTES at a time."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(text), PART_BYTES):
        part = text[at : at + PART_BYTES + 2]
        part += b"\0" * (min(PART_BYTES, len(text) - at) + 2 - len(part))
        counts += np.bincount(buckets(np.frombuffer(part, dtype=np.uint8).astype(np.uint32)), minlength=BUCKETS)
    return counts


def coded(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A length byte and BUCKETS codes for each row of counters."""
    quartiles = (BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4)
    ranks = np.partition(counts, quartiles, axis=1)
    codes_ = sum((counts > ranks[:, k, None]).astype(np.uint8) for k in quartiles)
    length = np.minimum(255, np.rint(LENGTH_STEPS * np.log2(lengths + 1.0))).astype(np.uint8)
    return np.concatenate([length[:, None], codes_], axis=1)


def text_of(coded: np.ndarray) -> list[str]:
    """Codes as hexadecimal digests."""
    four = coded[:, 1:].reshape(len(coded), BUCKETS // 4, 4)
    packed = four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]
    return [bytes(row).hex() for row in np.concatenate([coded[:, :1], packed.astype(np.uint8)], axis=1)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of codes, from 0 (as unlike as unrelated texts) to 1 (equal digests)."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    apart = np.abs(a[:, 1:] - b[:, 1:]).sum(axis=1) + 2 * np.minimum(np.abs(a[:, 0] - b[:, 0]), LENGTH_MOST)
    return np.maximum(0.0, 1.0 - apart / (UNRELATED * BUCKETS))


def likeness_of(a: str, b: str) -> float:
    """Of two hexadecimal digests."""

    def opened(x: str) -> np.ndarray:
        raw = np.frombuffer(bytes.fromhex(x), dtype=np.uint8)
        return np.concatenate([raw[:1], np.stack([raw[1:] >> s & 3 for s in (6, 4, 2, 0)], axis=1).reshape(-1)])[None, :]

    return float(likeness(opened(a), opened(b))[0])


def ranged(rows: DataFrame) -> DataFrame:
    """rows (doc_id, h, text) with `range`, numbered in the order of falling doc_id, then rising h."""
    spark = rows.sparkSession
    known, every = rows.agg(F.count("doc_id"), F.count(F.lit(1))).first()
    n, n_null = (int(min(RANGES_MOST, k // RANGE_ROWS + 1)) for k in (known, every - known))
    cuts = rows.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    # Doubles tell whole numbers apart up to 2 ** 53; beyond, neighbouring ids may share one and stay in one range.
    often = {c: k for c, k in Counter(cuts).items() if k > 1 and abs(c) < 2**53}
    inner = sorted({*cuts, *(math.nextafter(c, math.inf) for c in often)})
    splits = [-math.inf, *inner, math.inf]
    table, start = [], 0
    for bucket in range(len(splits) - 2, -1, -1):
        parts = often.get(splits[bucket], 1)
        table.append((bucket, start, parts))
        start += parts
    table.append((-1, start, n_null))
    at = F.col("doc_id").cast("double")
    if inner:
        cut = Bucketizer(splits=splits, inputCol="at", outputCol="bucket", handleInvalid="keep")
        rows = cut.transform(rows.withColumn("at", F.coalesce(at, F.lit(0.0)))).withColumn("bucket", F.col("bucket").cast("int")).drop("at")
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("bucket")))
    share = (F.col("h").cast("double") + float(2**63)) / float(2**64)
    part = F.least(F.floor(share * F.col("parts")), F.col("parts") - 1)
    # Two rows a range at most, RANGES_MOST * 2 + 2 in all: numbers, never texts.
    return rows.join(F.broadcast(spark.createDataFrame(table, "bucket int, start long, parts long")), "bucket").withColumn("range", (F.col("start") + part).cast("int")).drop("bucket", "start", "parts")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id and text, dealt by range in descending doc_id, each range closed by the row that follows it (tail = 1)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = ranged(rows)
    # The first row of each range: the largest id, then the least hash. One row a range.
    first = F.max(F.struct(F.col("doc_id"), F.bitwise_not("h").alias("not_h"))).alias("first")
    heads = sorted((int(r["range"]), r["first"]["doc_id"], ~r["first"]["not_h"]) for r in rows.groupBy("range").agg(first).collect())
    tails = [(heads[i - 1][0], *head) for i, head in enumerate(heads)]
    table = spark.createDataFrame(tails, "to int, of int, head long, head_h long")
    closing = rows.join(F.broadcast(table), (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")))
    closing = closing.groupBy("to", "doc_id", "h").agg(F.min("text").alias("text")).select(F.col("to").alias("range"), F.lit(1).alias("tail"), "doc_id", "h", "text")
    dealt = rows.select("range", F.lit(0).alias("tail"), "doc_id", "h", "text").unionByName(closing)
    return dealt.repartition("range").sortWithinPartitions("range", "tail", F.col("doc_id").desc_nulls_last(), "h", "text").drop("h")


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's digest, that of its text edited by the next document's, and how like they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str]] = []

        def pairs(rows: list[tuple[int, int, int | None, str]]) -> pa.RecordBatch:
            """Of all rows but the last; a tail gives none."""
            texts = [r[3] for r in rows]
            edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:], strict=False)]
            raw = [t.encode("utf-8") for t in edited]
            plain, changed = codes([t.encode("utf-8") for t in texts]), codes(raw)
            use = [i for i in range(len(rows) - 1) if not rows[i][1]]
            near, further = likeness(plain[:-1], changed), likeness(plain[:-1], plain[1:])
            prints, changed_prints = text_of(plain), text_of(changed)
            columns = [
                pa.array([rows[i][2] for i in use], type=pa.int64()),
                pa.array([len(texts[i]) for i in use], type=pa.int64()),
                pa.array([hashlib.sha256(raw[i]).hexdigest() for i in use], type=pa.string()),
                pa.array([prints[i] for i in use], type=pa.string()),
                pa.array([changed_prints[i] for i in use], type=pa.string()),
                pa.array(near[use], type=pa.float64()),
                pa.array(further[use], type=pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FINGERPRINTS.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [*held, *zip(*(c.to_pylist() for c in part.columns), strict=True)]
                if len(rows) > 1:
                    yield pairs(rows)
                held = rows[-1:]

    return with_next(docs).mapInArrow(run, FINGERPRINTS)


def op5_digest(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
