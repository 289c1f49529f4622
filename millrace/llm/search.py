"""Exact top-k search by inner product, with pivot-table elimination.

Vectors are whole numbers. For the query q, a candidate x and any pivot p the triangle
inequality gives |q - x| >= |d(q, p) - d(x, p)|; the largest of these over all pivots is
a lower bound on the distance, and so

    q . x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + |x|^2 - bound^2) / 2.

A sample of SEEDS rows of each dimension, the first by a hash, is shared with all tasks;
the first PIVOTS of them are the pivots. Distances to the pivots are computed once for
every candidate and stored beside it. Seeds are candidates, so the k-th best score of a
query among them is a threshold that no better row can fall below; a query takes it along
to every block of candidates and raises it there. In a block, candidates whose bound is
below the threshold are never looked at; the others are evaluated in the order of their
bound, in growing chunks, until no remaining bound reaches the threshold: what is skipped
cannot be among the best k. `evaluated_share` reports how many candidates were evaluated.

Candidates are dealt once, as blocks of rows, to places of PLACE_ROWS rows; query blocks,
the small side, travel to every place, and a task streams them past the candidates that it
holds. Queries beyond WAVE_QUERIES are worked through in waves, so that a task's work is
bounded as well as its memory. A place leaves its k best per query; these lists are merged
by rank.

Defined cases. Vectors that are null or hold null or non-finite components take no part,
as query or candidate; neither do empty ones, those without an id, or pairs of differing
dimension. Fewer than k candidates: all of them. A query's own row is left out: with a
column `row` on both sides the row of that number, else all rows of its vec_id. Repeated
rows: each is a candidate, and a query with ranks of its own. Ties go to the smaller
vec_id. Empty table: no rows. Scores must fit 64 bits; arithmetic is exact, in float64
while every sum is below 2**53 and in whole numbers beyond. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

TOP = 10
PIVOTS = 64
#: Rows of a dimension that all tasks know, at most, and the numbers in them, at most.
SEEDS, SEED_VALUES = 4096, 1 << 20
#: Candidates evaluated before the bounds are looked at again, at first; each further chunk is twice as large.
CHUNK = 128
#: Rows in a block of queries and of candidates.
QUERY_ROWS, CANDIDATE_ROWS = 256, 8192
#: Candidates of a place, and queries of a wave, about.
PLACE_ROWS, WAVE_QUERIES = 1 << 18, 1 << 20


def integral(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as double; null where the vector takes no part."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    good = (F.size(wide) > 0) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(good, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


@dataclass(frozen=True)
class Seeds:
    """Rows of one dimension that all tasks know; the first `pivots` of them are the pivots."""

    rows: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    pivots: int

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of every row of x to every pivot, in single precision."""
        x, p = x.astype(np.float64), self.vectors[: self.pivots].astype(np.float64)
        return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * (x @ p.T))).astype(np.float32)

    def thresholds(self, rows: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of every query among the seeds but its own row; the least number where there are fewer."""
        out = np.full(len(x), LEAST, dtype=np.int64)
        scores = products(x, self.vectors)
        for i, row in enumerate(rows.tolist()):
            own = scores[i][self.rows != row]
            if len(own) >= k:
                out[i] = np.partition(own, len(own) - k)[len(own) - k]
        return out


LEAST = np.iinfo(np.int64).min


def seeds_of(vectors: DataFrame, seeds: int, pivots: int) -> dict[int, Seeds]:
    """The first rows of every dimension by a hash: SEED_VALUES numbers at most, but PIVOTS rows at least."""
    dim = F.size("vector")
    sized = vectors.select("row", "vec_id", "vector", dim.alias("dim"), F.xxhash64("row", "vec_id").alias("h"))
    at = F.row_number().over(Window.partitionBy("dim").orderBy("h", "row"))
    rows = sized.withColumn("at", at).where(F.col("at") <= seeds).where((F.col("at") <= pivots) | (F.col("at") * F.col("dim") <= SEED_VALUES))
    found: dict[int, list] = {}
    for r in rows.collect():
        found.setdefault(r["dim"], []).append((r["at"], r["row"], r["vec_id"], r["vector"]))
    out = {}
    for size, some in found.items():
        some.sort(key=lambda r: r[0])
        out[size] = Seeds(*(np.array([r[c] for r in some], dtype=np.int64) for c in (1, 2, 3)), min(pivots, len(some)))
    return out


BLOCK_SCHEMA = "block long, dim int, width int, n long, rows binary, ids binary, data binary, extra binary"


def packed(vectors: DataFrame, size: int, label: str, seeds: dict[int, Seeds], k: int | None = None) -> DataFrame:
    """Stored blocks of rows (row, vec_id, vector) of one dimension, with their distances to the pivots, or as queries (k is given) with their thresholds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal n
            rows, ids, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            order = np.argsort(ids, kind="stable")
            rows, ids, x = rows[order], ids[order], x[order]
            most = int(np.abs(x.astype(np.float64)).max(initial=0.0))
            width = next(w for w in (2, 4, 8) if most < 2 ** (8 * w - 1) - 1 or w == 8)
            extra = seeds[dim].distances(x) if k is None else seeds[dim].thresholds(rows, x, k)
            out = [task << 32 | n, dim, width, len(rows), rows.tobytes(), ids.tobytes(), x.astype(f"<i{width}").tobytes(), extra.tobytes()]
            n += 1
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(out, kinds, strict=True)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            rows, ids, vec = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            flat, offsets = vec.flatten().to_numpy().astype(np.int64), np.cumsum([0, *vec.value_lengths().to_pylist()])
            sizes = np.diff(offsets)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                for a in range(0, len(at), size):
                    part = at[a : a + size]
                    held.setdefault(dim, []).append((rows[part], ids[part], flat[offsets[part][:, None] + np.arange(dim)]))
                    if sum(len(h[0]) for h in held[dim]) >= size:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return stored(vectors.select("row", "vec_id", "vector").mapInArrow(run, BLOCK_SCHEMA), label)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    top = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2**62:
        return a @ b.T
    return np.array(a.astype(object) @ b.astype(object).T)


class Held:
    """A block of candidates as a task holds it: vectors, squared lengths, and the stored distances to the pivots, pivot by pivot."""

    def __init__(self, row: dict):
        self.rows, self.ids = (np.frombuffer(row[c], dtype=np.int64) for c in ("rows", "ids"))
        self.x = np.frombuffer(row["data"], dtype=f"<i{row['width']}").reshape(len(self.ids), row["dim"])
        self.table = np.ascontiguousarray(np.frombuffer(row["extra"], dtype=np.float32).reshape(len(self.ids), -1).T)
        self.low, self.high = self.table.min(axis=1), self.table.max(axis=1)
        self.squares = (self.x.astype(np.float64) ** 2).sum(axis=1)


class Search:
    """One block of queries on its way past blocks of candidates: thresholds, and the k best so far."""

    def __init__(self, row: dict, seeds: Seeds, k: int):
        self.rows, self.ids, self.least = (np.frombuffer(row[c], dtype=np.int64) for c in ("rows", "ids", "extra"))
        self.least = self.least.copy()
        self.x = np.frombuffer(row["data"], dtype=f"<i{row['width']}").reshape(len(self.ids), row["dim"]).astype(np.int64)
        self.mine, self.k = seeds.distances(self.x), k
        self.squares = (self.x.astype(np.float64) ** 2).sum(axis=1)
        # Distances are rounded: what a difference may be too large by, but for a share of itself.
        length = np.sqrt((seeds.vectors[: seeds.pivots].astype(np.float64) ** 2).sum(axis=1))
        self.slack = (4e-7 * self.mine + 1e-7 * length[None, :]).astype(np.float32)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.ids]
        self.met = self.evaluated = 0

    def most(self, i: int, apart: np.ndarray, squares: np.ndarray | float) -> np.ndarray:
        """The largest score at such distances from query i, on the safe side of rounding."""
        apart = np.maximum(apart.astype(np.float64), 0.0) * (1 - 4e-7)
        size = self.squares[i] + squares
        return (size - apart * apart) / 2.0 + 1e-6 * size + 1.0

    def meet(self, held: Held) -> None:
        longest = held.squares.max()
        for i in range(len(self.ids)):
            self.met += len(held.ids)
            # The whole block first, by the range of its distances to each pivot.
            outside = (np.maximum(self.mine[i] - held.high, held.low - self.mine[i]) - self.slack[i]).max()
            if self.most(i, outside, longest) < self.least[i]:
                continue
            apart = np.zeros(len(held.ids), dtype=np.float32)
            for p in range(len(held.table)):
                np.maximum(apart, np.abs(held.table[p] - self.mine[i, p]) - self.slack[i, p], out=apart)
            bound = self.most(i, apart, held.squares)
            turn = np.flatnonzero((bound >= self.least[i]) & (held.rows != self.rows[i]))
            turn = turn[np.argsort(-bound[turn], kind="stable")]
            ids, scores = self.found[i]
            at, chunk = 0, CHUNK
            while at < len(turn) and bound[turn[at]] >= self.least[i]:
                part = turn[at : at + chunk]
                at, chunk = at + chunk, 2 * chunk
                self.evaluated += len(part)
                fresh = products(self.x[i : i + 1], held.x[part])[0]
                good = fresh >= self.least[i]
                ids, scores = np.concatenate([ids, held.ids[part[good]]]), np.concatenate([scores, fresh[good]])
                keep = np.lexsort((ids, -scores.astype(object) if scores.dtype == object else -scores))[: self.k]
                ids, scores = ids[keep], scores[keep]
                if len(scores) == self.k:
                    self.least[i] = max(self.least[i], int(scores[-1]))
            self.found[i] = ids, scores


RESULT_SCHEMA = "q_block long, q_place long, query_id long, vec_id long, score long, met long, evaluated long"


def searched(queries: DataFrame, candidates: DataFrame, k: int = TOP, pivots: int = PIVOTS, seeds: int = SEEDS) -> DataFrame:
    """Every place's k best of every query, and a row without a score for every query block and place that counts candidates met and evaluated."""
    if "row" not in queries.columns or "row" not in candidates.columns:
        queries, candidates = (t.select(F.col("vec_id").alias("row"), "vec_id", "vector") for t in (queries, candidates))
    spark = candidates.sparkSession
    known = spark.sparkContext.broadcast(seeds_of(candidates, seeds, pivots))  # SEED_VALUES numbers a dimension, or PIVOTS rows
    seeded = sorted(known.value)
    right = packed(candidates, CANDIDATE_ROWS, "search-rows", known.value)
    left = packed(queries.where(F.size("vector").isin(seeded)), QUERY_ROWS, "search-queries", known.value, k)
    # One row a dimension. At least as many places as tasks can run, so long as there are blocks for them.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = right.groupBy("dim").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))
    places = sizes.select("dim", F.greatest(F.ceil(F.col("n") / PLACE_ROWS), F.least(F.col("blocks"), F.lit(tasks))).alias("places"))
    waves = left.groupBy("dim").agg(F.ceil(F.sum("n") / WAVE_QUERIES).alias("waves"))
    shape = stored(places.join(waves, "dim"), "search-shape")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("block"), F.col(n)).cast("long")
    columns = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    stay = right.join(shape, "dim").select(*columns, F.lit(0).alias("kind"), own("places").alias("place"), all_of("waves").alias("wave"))
    travel = left.join(shape, "dim").select(*columns, F.lit(1).alias("kind"), own("waves").alias("wave"), all_of("places").alias("place"))
    n_tasks = shape.agg(F.sum(F.col("places") * F.col("waves"))).first()[0] or 1
    dealt = stay.unionByName(travel).repartition(max(tasks, int(n_tasks)), "dim", "place", "wave").sortWithinPartitions("dim", "place", "wave", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if here != (row["dim"], row["place"], row["wave"]):
                    here, held = (row["dim"], row["place"], row["wave"]), []
                if not row["kind"]:
                    held.append(Held(row))
                    continue
                search = Search(row, known.value[row["dim"]], k)
                for block in held:
                    search.meet(block)
                counts = [len(s) for _, s in search.found]
                end = [None] * sum(counts)
                columns = [
                    # Rows that share a vec_id are queries of their own, told apart by block and place.
                    [row["block"]] * (len(end) + 1),
                    [*np.repeat(np.arange(len(counts)), counts).tolist(), None],
                    [*np.repeat(search.ids, counts).tolist(), None],
                    [*(v for ids, _ in search.found for v in ids.tolist()), None],
                    [*(int(v) for _, scores in search.found for v in scores), None],
                    [*end, search.met],
                    [*end, search.evaluated],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=[c.split()[0] for c in RESULT_SCHEMA.split(", ")])

    return dealt.mapInArrow(run, RESULT_SCHEMA)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = TOP, pivots: int = PIVOTS, seeds: int = SEEDS) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have vec_id and vector (array of long), and row where a row is to miss itself alone."""
    order = Window.partitionBy("q_block", "q_place").orderBy(F.col("score").desc(), "vec_id")
    lists = searched(queries, candidates, k, pivots, seeds).where("score is not null")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def evaluated_share(queries: DataFrame, candidates: DataFrame, k: int = TOP, pivots: int = PIVOTS, seeds: int = SEEDS) -> DataFrame:
    """One row: candidates met by all queries, and how many of them were evaluated."""
    return searched(queries, candidates, k, pivots, seeds).agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum("evaluated"), F.lit(0)).alias("evaluated"))


def vectors_of(rows: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id and vector of every row of embeddings that takes part, stored, so that numbers stay."""
    whole = rows.select(F.col("vec_id").cast("long"), integral(F.col("embedding")).alias("vector")).where("vector is not null and vec_id is not null")
    return stored(whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector"), "search-vectors")


def op6_search(spark, sf_dir: str) -> DataFrame:
    vectors = vectors_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(1024::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""
