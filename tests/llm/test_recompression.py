import hashlib
import random

import numpy as np

from millrace.llm import recompression
from millrace.llm.exchange import packed, unpacked


def plain(rows: list[tuple[int | None, str | None]], width: int = 13) -> dict:
    first: dict = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    rank = lambda i: (i is None, i or 0)
    for i, w in words:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, rank(i)), rank(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < rank(i):
                gone[s : s + width] = [True] * width
        out.append((i is None, i or 0, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


def got(df) -> list:
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in df.collect())


def test_awkward_documents(awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert got(recompression.removed(awkward)) == plain(rows)
    assert recompression.removed(empty).count() == 0


def test_against_brute_force_on_few_words(spark):
    """Few distinct words: runs, periods and chance repeats at every offset."""
    r = random.Random(3)
    rows = []
    for i in range(120):
        text = " ".join(r.choice(["a", "b", "c"][: r.choice([1, 2, 3])]) for _ in range(r.randrange(0, 60)))
        if rows and r.random() < 0.4:
            other = r.choice(rows)[1].split()
            a = r.randrange(len(other) + 1)
            text += " " + " ".join(other[a : a + r.randrange(5, 40)])
        rows.append((i, text))
    rows += [(200, "z " * 50), (201, "q " * 3 + "z " * 14 + "q"), (202, "z " * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(recompression.removed(df)) == plain(rows)
    assert got(recompression.removed(df, block_bytes=300, bucket_names=20)) == plain(rows)


def test_sure_symbols_are_the_same_wherever_a_window_occurs():
    """Symbols whose context lies within given words occur at the same offsets beside any other words."""
    r = np.random.default_rng(0)
    some = 0
    for kinds in (2, 3, 5, 40):
        for _ in range(150):
            core = r.integers(0, kinds, 13, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            seen = []
            for _ in range(4):
                left, right = (r.integers(0, kinds, int(r.integers(0, 9)), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
                other = r.integers(0, kinds, 5, dtype=np.uint64)
                names = np.concatenate([other, left, core, right, other])
                found = recompression.recompressed(names, np.array([5, len(left) + 13 + len(right), 5]))
                at = 5 + len(left)
                assert (np.diff(found.low) >= 0).all() and (np.diff(found.high) >= 0).all()
                sure = (found.low >= at) & (found.high <= at + 13)
                seen.append(list(zip((found.low[sure] - at).tolist(), (found.high[sure] - at).tolist(), found.names[sure].tolist())))
                key = recompression.window_keys(names, np.array([5, len(left) + 13 + len(right), 5]), np.array([7], dtype=np.uint64), np.array([at]))
                seen[-1].append(int(key[0]))
            assert all(s == seen[0] for s in seen)
            some += len(seen[0]) > 1
    assert some > 400


def test_a_round_by_hand():
    """Runs become one symbol, then each pair of class L and class R; contexts hold the neighbours that were looked at."""
    left = next(x for x in range(1, 10**6) if (x >> 17) & 1 == 0)
    right = next(x for x in range(1, 10**6) if (x >> 17) & 1)
    outside = (np.array([-1]), np.array([6]))
    words = np.array([right, left, right, left, left], dtype=np.uint64)
    at = np.arange(5)
    start = recompression.Symbols(words, np.zeros(5, np.int64), at, at + 1)
    runs = start.runs(outside)
    assert runs.names[:3].tolist() == [right, left, right] and len(runs.names) == 4
    assert runs.low.tolist() == [-1, 0, 1, 2] and runs.high.tolist() == [2, 3, 4, 6]
    pairs = runs.pairs(outside)
    assert len(pairs.names) == 3 and pairs.low.tolist()[:2] == [-1, 0] and pairs.high.tolist()[:2] == [2, 4]


def test_the_largest_id_is_none_like_null(spark):
    """A doc_id of 2**63 - 1 is an id like any other; null comes after it."""
    most, text = 2**63 - 1, " ".join(f"w{i}" for i in range(20))
    rows = [(most, text), (None, text), (most - 1, "x " + text), (None, "y " + " ".join(f"v{i}" for i in range(14))), (most, " ".join(f"v{i}" for i in range(14)))]
    for size in (1 << 20, 10):
        assert got(recompression.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), block_bytes=size)) == plain(rows)


def test_payloads_come_back():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        names = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        assert (unpacked(packed(names)) == names).all()
    dense = np.arange(10_000, dtype=np.uint64) * np.uint64(977)
    assert (unpacked(packed(dense)) == dense).all()


def test_query_hashes_kept_words(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r["kept_sha256"] for r in recompression.op10_recompression(spark, str(tmp_path)).collect()}
    assert rows == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
