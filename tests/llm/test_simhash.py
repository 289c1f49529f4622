import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import simhash


def plain_fingerprint(text: str | None, width: int = 4) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values: list[int], radius: int = 4) -> list[int]:
    parent = list(range(len(values)))
    for _ in values:
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= radius:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    return parent


def test_awkward_documents(awkward):
    rows = simhash.components_of(awkward).collect()
    assert len(rows) == awkward.count()
    docs = awkward.select("doc_id", "text").collect()
    expected = sorted((r["doc_id"] is None, r["doc_id"] or 0, plain_fingerprint(r["text"])) for r in docs)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % 2**64) for r in rows) == expected
    values = [plain_fingerprint(r["text"]) for r in docs]
    groups = plain_components(values)
    low = {g: min((d["doc_id"] for d, x in zip(docs, groups) if x == g and d["doc_id"] is not None), default=None) for g in set(groups)}
    by_value = {v: low[g] for v, g in zip(values, groups)}
    assert all(by_value[r["fp"] % 2**64] == r["component_id"] for r in rows)
    # Null, empty and blank texts are one group, as are the copies.
    assert {r["component_id"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0}


def test_deduplicate_keeps_columns_and_one_of_each_group(awkward, empty):
    kept = simhash.deduplicate(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len([i for i in ids if i == 5]) == 1 and 6 not in ids and 0 in ids and 1 not in ids
    assert simhash.deduplicate(empty).count() == 0 and simhash.components_of(empty).count() == 0


def test_deduplicate_keeps_one_row_of_each_component_whatever_its_ids(spark, awkward):
    a, b, c, d = (" ".join(f"{x}{i * i % 97}" for i in range(80)) for x in "abcd")
    # Nulls alone, a repeated id with different texts, a null beside an id, and many copies of one null row.
    rows = [(None, a), (None, b), (None, b), (3, c), (3, d), (4, c), (None, d), (None, None), (None, " ")] + [(None, a)] * 50
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    blank = [r for r in kept if not (r["text"] or "").strip()]
    assert len(blank) == 1 and blank[0]["doc_id"] is None
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept if r not in blank) == sorted([(0, a), (0, b), (3, c), (3, d)])
    docs = awkward.select("doc_id", "text").collect()
    groups = plain_components([plain_fingerprint(r["text"]) for r in docs])
    kept = simhash.deduplicate(awkward).collect()
    found = [plain_fingerprint(r["text"]) for r in kept]
    by_value = {plain_fingerprint(r["text"]): g for r, g in zip(docs, groups)}
    assert sorted(by_value[v] for v in found) == sorted(set(groups))
    assert (None, "no id") in [(r["doc_id"], r["text"]) for r in kept]


def test_links_among_dense_and_spread_values(spark):
    r = np.random.default_rng(5)
    centres = r.integers(0, 2**63, 12, dtype=np.int64)
    values = {int(c) for c in centres}
    for c in centres[:4]:
        for _ in range(40):
            v = int(c)
            for b in r.choice(63, size=int(r.integers(1, 6)), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    values = sorted(values)
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {x["node"]: x["root"] for x in simhash.components(simhash.links(nodes)).collect()}
    groups = plain_components(values)
    expected = {v: values[g] for v, g in zip(values, groups)}
    assert {v: roots.get(v, v) for v in values} == expected


def test_buckets_that_hold_too_many_are_dealt_out_again(spark, monkeypatch):
    """Fingerprints that agree on all their low bits share buckets; finer tables part them and lose no link."""
    monkeypatch.setattr(simhash, "BUCKET_MOST", 100)
    r = np.random.default_rng(7)
    values = sorted({int(x) << 45 | 0x155 for x in r.integers(0, 2**18, 300)} | {int(x) for x in r.integers(0, 2**63, 100, dtype=np.int64)})
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {x["node"]: x["root"] for x in simhash.components(simhash.links(nodes)).collect()}
    low = {v: values[g] for v, g in zip(values, plain_components(values))}
    assert {v: roots.get(v, v) for v in values} == low


def test_pivots_discard_unrelated_pairs(spark):
    r = np.random.default_rng(3)
    values = [int(x) for x in np.unique(r.integers(-(2**63), 2**63, 20_000, dtype=np.int64))]
    near = [v ^ 1 for v in values[:50]]
    row = simhash.pair_counts(spark.createDataFrame([(v,) for v in {*values, *near}], "fp long")).first()
    assert row["met"] > 100_000 and row["linked"] >= 50 and row["survived"] - row["linked"] < row["met"] / 1000


def test_bucket_links_are_those_of_all_pairs():
    r = np.random.default_rng(4)
    for n in (1, 2, 30, 200):
        values = np.unique(np.concatenate([r.integers(0, 2**63, n).astype(np.uint64), (r.integers(0, 2**63, 3).astype(np.uint64)[:, None] ^ (np.uint64(1) << r.integers(0, 63, (3, n // 3 + 1)).astype(np.uint64))).reshape(-1)]))
        keys = r.integers(0, 3, len(values))
        a, b, counts = simhash.bucket_links(keys, values, 4)
        links = [(i, j) for i in range(len(values)) for j in range(i) if keys[i] == keys[j] and int(values[i] ^ values[j]).bit_count() <= 4]
        assert counts[2] == len(links) and counts[1] >= counts[2] and counts[0] == sum(int(c) * (int(c) - 1) // 2 for c in np.bincount(keys))

        def groups(edges) -> set:
            part = {int(v): {int(v)} for v in values}
            for x, y in edges:
                joined = part[x] | part[y]
                for v in joined:
                    part[v] = joined
            return {frozenset(p) for p in part.values()}

        assert groups(zip(a.tolist(), b.tolist())) == groups((int(values[i]), int(values[j])) for i, j in links) and len(a) == len(values) - len(groups(zip(a.tolist(), b.tolist())))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 2**40), st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_every_pair_within_the_radius_shares_a_table_key(nodes, value, flipped):
    other = value
    for b in flipped:
        other ^= 1 << b
    key = lambda v, table: tuple(v >> s & ((1 << w) - 1) for s, w in table)
    assert any(key(value, t) == key(other, t) for t in simhash.tables_of(simhash.table_plan(nodes)))


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and found[101] == 100


def test_clashing_and_awkward_column_names(spark):
    a, b = (" ".join(f"{x}{i * i % 97}" for i in range(80)) for x in "ab")
    df = spark.createDataFrame([(1, a, 5, 6, "x"), (2, b, 7, 8, "y"), (3, a, 9, 10, "z")], "doc_id long, text string, _sim_no int, `a.b` int, fp string")
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == [(1, a, 5, 6, "x"), (2, b, 7, 8, "y")]
