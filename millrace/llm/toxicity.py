"""Toxicity by maximum-scoring segments.

A token is a run of letters; its features are the lower-cased word and its first 4, 5
and 6 bytes, so that inflected forms of a stem count together. A feature's weight is its
log-odds between toxic and other labelled documents under an informative Dirichlet
prior (Monroe, Colaresi and Quinn); features whose log-odds are not many standard errors
above zero weigh nothing. Every token scores the largest weight of its features, less a
drift that makes the expected score of ordinary text negative.

All maximal scoring segments of a text are found by one linear scan (Ruzzo and Tompa),
which visits the tokens that score above zero. Under the other documents' score
distribution the best of m tokens' segments follows an extreme-value law (Karlin and
Altschul): P(S >= x) = 1 - exp(-K m exp(-L x)). L solves the law's equation for the
token scores, K is fitted to the other documents. Segments with an expected number of
such scores below SIGNIFICANT are toxic passages. The evidence of a document's best
segment and of all its passages is turned into a probability by logistic calibration.

Labels are learnt from rows whose crc32(doc_id as text) mod 4 is not 2, at most
TRAIN_ROWS of them, the first by a hash of doc_id; near copies among them (equal least
hash of five-word shingles) count once, as the one of least doc_id, then text hash. The
sample is bounded by that parameter, and with it the table of weights: every feature that
passes the test of its odds has one. Every text is scored whole. The same rows give the
same model however they are dealt out.

Defined cases. Null or empty text: no tokens, no segment, the score of that evidence.
Null doc_id: scored, held_out false, never learnt from. Labels that are null are left
out; of several labels of a document the largest counts. Repeated rows: each is scored.
No labels, or labels of one kind: every score is their share of toxic ones (0 without
any). Empty table: no rows. Other columns are ignored by the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import numbered, place_of, scrambled, steps, stored, utf8, window_names, word_names, without

#: Labelled rows that are learnt from, at most.
TRAIN_ROWS = 20_000
#: The prior's weight, in documents; the least documents and standard errors of a feature.
PRIOR, LEAST_DOCS, LEAST_Z = 20.0, 6, 4.0
PREFIXES = (4, 5, 6)
DRIFT = 0.25
#: Expected chance segments of that score, below which a segment is a toxic passage.
SIGNIFICANT = 0.05
THRESHOLD = 0.3

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of each run of letters, and their number per document."""
    data = data.copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    n = len(offsets) - 1
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    inside = np.concatenate([_LETTER[data], [False]])
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[:-1] & (np.concatenate([[True], ~inside[:-2]]) | cut[:-1]))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut[1:])) + 1
    return data, starts, ends, np.diff(np.searchsorted(starts, offsets))


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Per kind of feature the name of every token's; a word that a prefix covers has its own name there."""
    out = [word_names(data, starts, ends)]
    for k in PREFIXES:
        out.append(scrambled(word_names(data, starts, np.minimum(ends, starts + k)) + np.uint64(k)))
    return out


@dataclass(frozen=True)
class Model:
    names: np.ndarray
    weights: np.ndarray
    law: tuple[float, float]  # L and K
    logistic: tuple[float, ...]
    drift: float = DRIFT

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Every token's score."""
        best = np.zeros(len(starts))
        if len(self.names):
            seen = np.zeros(1 << 16, dtype=bool)
            seen[(self.names & np.uint64(0xFFFF)).astype(np.int64)] = True
            for kind in features(data, starts, ends):
                at = np.flatnonzero(seen[(kind & np.uint64(0xFFFF)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.names, kind[at]), len(self.names) - 1)
                hit = self.names[place] == kind[at]
                best[at[hit]] = np.maximum(best[at[hit]], self.weights[place[hit]])
        return best - self.drift


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), in order, in linear time."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum after
    for i, low, high in zip(positive.tolist(), sums[positive].tolist(), sums[positive + 1].tolist(), strict=True):
        first, end = i, i + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
        found.append((first, end, low, high))
    return [(a, b, high - low) for a, b, low, high in found]


def evidence(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per document (tokens, best segment, significant segments, their sum), the passages, and the tokens."""
    data, starts, ends, counts = tokens(data, offsets)
    scores = model.scores(data, starts, ends)
    law_l, law_k = model.law
    out, passages, first = np.zeros((len(counts), 4)), [], 0
    for i, n in enumerate(counts.tolist()):
        found = segments(scores[first : first + n])
        good = [(a, b, s) for a, b, s in found if law_k * n * np.exp(-law_l * s) < SIGNIFICANT]
        out[i] = n, max((s for _, _, s in found), default=0.0), len(good), sum(s for _, _, s in good)
        passages.append([(first + a, first + b, s) for a, b, s in good])
        first += n
    return out, passages, (starts, ends, counts)


def _inputs(law: tuple[float, float], out: np.ndarray) -> np.ndarray:
    """What the calibration sees: the best segment's evidence, the passages' number and their density."""
    n, best, k, total = out.T
    sure = np.clip(law[0] * best - np.log(law[1] * np.maximum(n, 1.0)), -10.0, 30.0)
    return np.stack([np.ones(len(out)), sure, np.log1p(k), np.log1p(total)], axis=1)


def probabilities(model: Model, out: np.ndarray) -> np.ndarray:
    z = _inputs(model.law, out) @ np.array(model.logistic)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        grown = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), grown)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def law_of(scores: np.ndarray, counts: np.ndarray, lengths: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """L and K from the other documents' token scores (with counts) and their best segments."""
    share = counts / max(1.0, counts.sum())
    if not (scores > 0).any() or not share[scores > 0].sum():
        return 1.0, 1.0
    low, high = 1e-6, 1.0
    moment = lambda t: float((share * np.exp(np.clip(t * scores, -700, 700))).sum())
    while moment(high) < 1 and high < 64:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 1 else (low, middle)
    rate = float((np.maximum(lengths, 1.0) * np.exp(-high * best)).sum())
    return high, max(1e-9, len(best) / max(rate, 1e-9))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, most: int | None = None) -> Model:
    """Weights, law and calibration from labelled rows that are not held out; of the weights the `most` surest, or all."""
    key = F.col("doc_id").cast("string")
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .where(F.crc32(key.cast("binary")) % 4 != 2)
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("y"))
        .orderBy(F.xxhash64(key), "doc_id")
        .limit(train_rows)  # the documented bound of the sample
    )
    texts = docs.select(F.col("doc_id").alias("d"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("d") == F.col("doc_id")).select("doc_id", "text", "y")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            data, starts, ends, counts = tokens(*utf8(batch.column(1)))
            names, at = window_names(word_names(data, starts, ends), counts, 5)
            least = np.asarray(scrambled(batch.column(0).to_numpy().astype(np.uint64)))  # short texts stand for themselves
            doc = np.repeat(np.arange(len(counts)), counts)[at]
            if len(at):
                first = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
                least[doc[first]] = np.minimum.reduceat(names, first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least.view(np.int64))], names=["doc_id", "text", "y", "copy"])

    marked = texts.select(F.col("doc_id").cast("long"), "text", "y").mapInArrow(mark, "doc_id long, text string, y int, copy long")
    # Of the copies the one of least doc_id, then hash: which row comes first decides nothing.
    least = F.min(F.struct("doc_id", F.xxhash64("text").alias("h"), "text"))
    sample = stored(marked.groupBy("copy", "y").agg(least.alias("r")).select("r.doc_id", "r.text", "y"), "toxicity-sample")
    classes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = classes.get(1, 0), sum(n for y, n in classes.items() if y != 1)
    if not n1 or not n0:
        share = min(max(n1 / max(1, n1 + n0), 1e-9), 1 - 1e-9)
        return Model(np.zeros(0, np.uint64), np.zeros(0), (1.0, 1.0), (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            data, starts, ends, counts = tokens(*utf8(batch.column(1)))
            doc = np.repeat(np.arange(len(counts)), counts).astype(np.uint64)
            y = batch.column(2).to_numpy() == 1
            all_names, all_y = [], []
            for kind in features(data, starts, ends):
                pairs = np.unique(np.stack([doc, kind]), axis=1) if len(kind) else np.zeros((2, 0), np.uint64)
                all_names.append(pairs[1])
                all_y.append(y[pairs[0].astype(np.int64)])
            names, hot = np.concatenate(all_names), np.concatenate(all_y)
            distinct, place = np.unique(names, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.view(np.int64)), *[pa.array(np.bincount(place, weights=w, minlength=len(distinct)).astype(np.int64)) for w in (hot, ~hot)]], names=["name", "a", "b"]
            )

    table = sample.select("doc_id", "text", "y").mapInArrow(count, "name long, a long, b long").groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    prior = F.lit(PRIOR) * (F.col("a") + F.col("b")) / float(n1 + n0)
    odds = F.log((F.col("a") + prior) / (n1 + PRIOR - F.col("a") - prior)) - F.log((F.col("b") + prior) / (n0 + PRIOR - F.col("b") - prior))
    z = odds / F.sqrt(F.lit(1.0) / (F.col("a") + prior) + F.lit(1.0) / (F.col("b") + prior))
    sure = table.where(F.col("a") + F.col("b") >= LEAST_DOCS).where((F.col("a") < n1) | (F.col("b") < n0)).select("name", odds.alias("odds"), z.alias("z"))
    ranked = sure.where(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "name")
    # As many as the bounded sample's texts have features that pass.
    rows = (ranked if most is None else ranked.limit(most)).collect()
    names = np.array([r["name"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(names)
    bare = Model(names[order], np.array([r["odds"] for r in rows])[order], (1.0, 1.0), (0.0, 0.0, 0.0, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(bare)

    def measured(law: tuple[float, float] | None) -> DataFrame:
        """A row of five numbers per text; without a law yet, also the batch's token scores above zero, in eighths, with their counts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, "text"):
                data, starts, ends, counts = tokens(*utf8(batch.column(1)))
                scores, first, out = shared.value.scores(data, starts, ends), 0, []
                for y, n in zip(batch.column(2).to_pylist(), counts.tolist(), strict=True):
                    found = [s for _, _, s in segments(scores[first : first + n])]
                    good = [] if law is None else [s for s in found if law[1] * n * np.exp(-law[0] * s) < SIGNIFICANT]
                    out.append((int(y == 1), n, max(found, default=0.0), len(good), float(sum(good)), None, None))
                    if law is None and y != 1:
                        own = scores[first : first + n]
                        levels, times = np.unique(np.rint(own[own > 0] * 8) / 8, return_counts=True)
                        out += [(None, None, None, None, None, x, k) for x, k in zip(levels.tolist(), times.tolist(), strict=True)]
                    first += n
                kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["y", "n", "best", "k", "total", "level", "times"])

        return sample.select("doc_id", "text", "y").mapInArrow(run, "y int, n long, best double, k long, total double, level double, times long")

    # What goes to the driver: five numbers for each of the TRAIN_ROWS texts at most, in an order of
    # their own, and one row for each eighth that a weight can round to.
    first_pass = stored(measured(None), "toxicity-scores")
    levels = sorted((r["level"], r["times"]) for r in first_pass.where("level is not null").groupBy("level").agg(F.sum("times").alias("times")).collect())
    other = sorted((r["n"], r["best"]) for r in first_pass.where("y = 0").select("n", "best").collect())
    lengths, best = (np.array(c, dtype=float) for c in zip(*other, strict=True))
    ordinary = lengths.sum() - sum(k for _, k in levels)
    law = law_of(np.array([*(x for x, _ in levels), -DRIFT]), np.array([*(k for _, k in levels), ordinary], dtype=float), lengths, best)
    table = np.array(sorted((r["y"], r["n"], r["best"], r["k"], r["total"]) for r in measured(law).drop("level", "times").collect()), dtype=float)
    weights = fitted(_inputs(law, table[:, 1:]), table[:, 0])
    shared.unpersist()
    return Model(bare.names, bare.weights, law, tuple(float(w) for w in weights))


def _scored(docs: DataFrame, place: int, model: Model, score: str, passages: str) -> DataFrame:
    """docs, whose texts are at `place`, with two more columns of these names."""
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    span = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())]))
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType()), StructField(passages, span)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its weights follow the bounded sample
    names = [*docs.columns, score, passages]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in steps(batches, place):
            data, offsets = utf8(batch.column(place))
            out, found, (starts, ends, _) = evidence(own, data, offsets)
            spans = [[{"start": int(starts[a] - offsets[i]), "end": int(ends[b - 1] - offsets[i]), "score": float(s)} for a, b, s in row] for i, row in enumerate(found)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probabilities(own, out)), pa.array(spans, type=kind)], names=names)

    return docs.mapInArrow(run, schema)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _tox_score and _tox_passages (spans of bytes of the UTF-8 text, with their score)."""
    docs = without(docs, "_tox_score", "_tox_passages")
    return _scored(numbered(docs), place_of(docs, "text"), model, "score", "passages").toDF(*docs.columns, "_tox_score", "_tox_passages")


def clean(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more; learnt from `training` (docs itself by default)."""
    model = learn(training if training is not None else docs, labels)
    plain = numbered(docs)
    left = _scored(plain, place_of(docs, "text"), model, "score", "passages").where(F.col("score") < threshold)
    return left.select(*plain.columns).toDF(*docs.columns)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    score = F.col("_tox_score")
    return scored(docs, model).select("doc_id", held.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), F.size("_tox_passages").alias("n_passages"))
