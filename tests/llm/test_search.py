import numpy as np
from pyspark.sql import functions as F

from millrace.llm import search


def plain(rows: dict, k: int = 10, queries=lambda i: i % 100 == 0) -> list[tuple]:
    out = []
    for q in sorted(i for i in rows if queries(i)):
        scored = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def test_against_brute_force_with_ties_and_bad_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 8) / 2]) for i in range(450)]
    rows += [(1000, None), (1100, []), (1200, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (1300, [float("nan")] * 8), (1400, [float("inf")] * 8), (1500, [1.0, 2.0]), (1501, [3.0, -4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    vectors = df.select("vec_id", search.integral(F.col("embedding")).alias("vector")).where("vector is not null")
    good = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows[:450] + rows[-2:]}
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in search.top_k(vectors.where("vec_id % 100 = 0"), vectors).collect())
    assert got == plain(good)


def test_few_candidates_large_values_and_empty(spark):
    rows = [(0, [1e6, -1e6]), (1, [2e6, 3e6]), (2, [-1e6, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = df.select("vec_id", search.integral(F.col("embedding")).alias("vector"))
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in search.top_k(vectors.where("vec_id = 0"), vectors).collect())
    assert got == plain({i: [int(1024 * x) for x in v] for i, v in rows}, queries=lambda i: i == 0)
    none = vectors.where("vec_id > 9")
    assert search.top_k(none, none).count() == 0


def ranks(df) -> list[tuple]:
    return sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in df.collect())


def test_pivots_skip_work_and_lose_nothing(spark):
    """Rows in groups: most candidates of other groups are never evaluated. Blocks, places and waves change nothing."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 20, (600, 16)) for c in (-900, 300, 900)]).astype(np.int64)
    ids = r.permutation(len(x))
    vectors = spark.createDataFrame([(int(i), [int(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, vector array<long>").repartition(3)
    queries = vectors.where("vec_id % 100 = 0")
    want = plain({int(i): v.tolist() for i, v in zip(ids, x)})
    row = search.evaluated_share(queries, vectors, seeds=300).first()
    assert row["met"] == 18 * 1800 and row["evaluated"] < row["met"] / 2
    assert ranks(search.top_k(queries, vectors, seeds=300)) == want
    assert ranks(search.top_k(queries, vectors, pivots=3, seeds=5)) == want


def test_places_and_waves(spark, monkeypatch):
    for name, value in (("QUERY_ROWS", 3), ("CANDIDATE_ROWS", 17), ("PLACE_ROWS", 40), ("WAVE_QUERIES", 4), ("CHUNK", 2)):
        monkeypatch.setattr(search, name, value)
    r = np.random.default_rng(5)
    rows = {i * 50: r.integers(-9, 10, 5).tolist() for i in range(60)} | {i * 50 + 1: r.integers(-9, 10, 3).tolist() for i in range(20)}
    vectors = spark.createDataFrame(list(rows.items()), "vec_id long, vector array<long>").repartition(4)
    assert ranks(search.top_k(vectors.where("vec_id % 100 = 0"), vectors, seeds=15)) == plain(rows)


def test_repeated_rows_and_other_columns(spark, tmp_path):
    """Rows that share an id are each a query and a candidate of the other; a row misses itself alone."""
    rows = [(100, [1.0, 0.0], "x"), (100, [1.0, 0.0], "y"), (100, [0.0, 2.0], "z"), (7, [3.0, 1.0], None), (200, None, "n"), (None, [1.0, 1.0], "i")]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string").repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    k = 1024 * 1024
    assert ranks(search.op6_search(spark, str(tmp_path))) == sorted([(100, 1, 7, 3 * k), (100, 2, 100, k), (100, 3, 100, 0)] * 2 + [(100, 1, 7, 2 * k), (100, 2, 100, 0), (100, 3, 100, 0)])


def test_bounds_are_on_the_safe_side():
    """With few pivots, far away, and long vectors, where distances are rounded most."""
    r = np.random.default_rng(6)
    for scale, far in ((1, 0), (1000, 10**6), (10, 10**9)):
        x = r.integers(-9, 10, (400, 6)) * scale + far
        seeds = search.Seeds(np.arange(3), np.arange(3), x[:3] - far, 3)
        row = {"rows": np.arange(400).tobytes(), "ids": np.arange(400).tobytes(), "data": x.astype("<i8").tobytes(), "width": 8, "dim": 6}
        held = search.Held(row | {"extra": seeds.distances(x).tobytes()})
        s = search.Search(row | {"extra": np.full(400, search.LEAST).tobytes()}, seeds, 10)
        for i in range(0, 400, 7):
            apart = np.zeros(400, dtype=np.float32)
            for p in range(3):
                np.maximum(apart, np.abs(held.table[p] - s.mine[i, p]) - s.slack[i, p], out=apart)
            assert (s.most(i, apart, held.squares) >= (x.astype(object) @ x[i].astype(object)).astype(np.float64)).all()
