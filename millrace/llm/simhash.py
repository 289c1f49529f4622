"""SimHash near-duplicates: fingerprints, exact links within a few bits, components.

Fingerprints are 64 bits: bit i is set if it is set in over half of the XXH64 values
(seed 42) of a text's word shingles. Equal fingerprints are one node from then on.

Links. The pivot distance table decides which pairs are looked at: the Hamming distances
of every fingerprint to PIVOTS reference fingerprints. Two fingerprints within RADIUS bits
have no coordinate that differs by more than RADIUS (the triangle inequality), so a pair
with a larger difference in any is discarded and no link is lost; what survives is
verified by its own distance. One coordinate keeps 57 of 100 pairs of unrelated
fingerprints, all 32 of them almost none (`pair_counts` reports pairs met, surviving and
linked).

Rows are sorted by the first coordinate, but sorted lists alone would leave a number of
pairs that grows with the square of the rows. A few coarse tables therefore deal rows out
first: two fingerprints within RADIUS bits agree exactly on all but RADIUS of the blocks
that the 64 bits are cut into, and each choice of blocks that may agree is one table.
`table_plan` takes as few tables as leave a node CROWD others to meet in a bucket, if bits
are spread evenly. Where they are not, a bucket of more than BUCKET_MOST nodes is dealt
out again by finer tables, in another Spark round, so that no task holds a hot bucket; the
finest tables leave 2 ** 16 values at most. A coordinate is one popcount: tasks fill the
table for the rows that they were dealt instead of carrying it through the shuffle.

A bucket's links leave it as a spanning forest, so a bucket of n nodes gives n - 1 rows at
most, however many of its pairs are links; the components are the same. A bucket holds
distinct fingerprints only, so its size has nothing to do with how many copies a text has.

Components are found by rounds of star contraction over node links, each round stored in
the shared folder; nothing of the graph goes to the driver but two counts.

Defined cases. Null or empty text, or white space alone: fingerprint zero, linked like
any other. Fewer words than a shingle: the whole sequence is the one shingle. Null
doc_id: it takes part, and a component of nulls alone has a null id; `deduplicate` goes by
the component's root, which is never null. Repeated rows: each gets its row. Empty table:
no rows. Other columns are ignored by `components_of` and carried along by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import dropped, numbered, place_of, scrambled, steps, stored, utf8, word_spans

SEED = 42
#: Fingerprints link at this many differing bits or fewer.
RADIUS = 4
#: Reference fingerprints of a pivot distance table: fixed pseudo-random words. The first FEW discard before the rest.
PIVOTS, FEW = 32, 8
#: Other nodes that a node meets in a bucket of evenly spread bits, at most.
CROWD = 32
#: Nodes of a bucket that one task compares; larger buckets are dealt out again.
BUCKET_MOST = 4096
#: Blocks that 64 bits are cut into, at most.
BLOCKS_MOST = 16
#: Pairs that are looked at in one step.
PAIRS_AT_ONCE = 1 << 20
#: Words of the pipeline's and op8's shingles.
SHINGLE = 4


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint of every document of a byte array, as uint64."""
    lowered = data.copy()
    upper = (lowered >= 65) & (lowered <= 90)
    lowered[upper] += 32
    starts, ends, counts = word_spans(lowered, offsets)
    lengths = ends - starts
    # The words again, each followed by one space, so that a shingle is one slice.
    at = np.cumsum(lengths + 1) - lengths - 1
    line = np.full(int((lengths + 1).sum()), 32, dtype=np.uint8)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    line[np.repeat(at, lengths) + place] = lowered[np.repeat(starts, lengths) + place]
    line = line.tobytes()
    end = at + lengths
    out = np.zeros(len(counts), dtype=np.uint64)
    digest, first = xxhash.xxh64_intdigest, 0
    for i, n in enumerate(counts.tolist()):
        if n:
            span = min(width, n)
            left, right = at[first : first + n - span + 1].tolist(), end[first + span - 1 : first + n].tolist()
            values = np.array([digest(line[a:b], SEED) for a, b in zip(left, right, strict=True)], dtype=np.uint64)
            ones = np.zeros(64, dtype=np.int64)
            for part in range(0, len(values), 1 << 14):
                ones += np.unpackbits(values[part : part + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out[i] = int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")
        first += n
    return out


def fingerprinted(docs: DataFrame, width: int = SHINGLE, keep_hashes: bool = False) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row (and its text's hashes h1 and h2, if kept)."""
    more = text_hashes() if keep_hashes else ()
    names = ["doc_id", "fp", "h1", "h2"][: 2 + len(more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            found = fingerprints(*utf8(batch.column(1)), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def text_hashes(name: str = "text") -> tuple[Column, Column]:
    """128 bits that tell texts apart, null from empty too."""
    text = F.col(name).cast("string")
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def tables_of(blocks: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """The tables of 64 bits in so many blocks: each the (shift, width) of the blocks that its key holds."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [[(cuts[b], cuts[b + 1] - cuts[b]) for b in chosen] for chosen in combinations(range(blocks), blocks - radius)]


def table_plan(nodes: int, radius: int = RADIUS) -> int:
    """The number of blocks for so many nodes."""
    return next((b for b in range(radius + 1, BLOCKS_MOST) if nodes <= CROWD * 2 ** (64 * (b - radius) / b)), BLOCKS_MOST)


def pivot_table(values: np.ndarray) -> np.ndarray:
    """Hamming distances of every value to the reference fingerprints."""
    golden = scrambled(np.arange(1, PIVOTS + 1, dtype=np.uint64))
    return np.bitwise_count(values[:, None] ^ golden[None, :]).astype(np.int8)


def bucket_links(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forest edges of all buckets, rows of equal keys, and how many pairs were met, survived the pivots and are links."""
    table = pivot_table(values)
    order = np.lexsort((table[:, 0], keys))
    keys, values, table = keys[order], values[order], table[order]
    n = len(values)
    bucket = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    sizes = np.bincount(bucket)
    counts = np.array([int((sizes * (sizes - 1) // 2).sum()), 0, 0])
    # Of the rows behind a row in its bucket, the first `reach` are near enough in the first coordinate.
    at = bucket * 256 + table[:, 0]
    reach = np.searchsorted(at, at + radius, side="right") - 1 - np.arange(n)
    parent, lefts, rights = np.arange(n), [], []

    def root(x: int) -> int:
        while parent[x] != x:
            x = int(parent[x])
        return x

    left = np.flatnonzero(reach > 0)
    step = 1
    while len(left):
        for a in range(0, len(left), PAIRS_AT_ONCE):
            i = left[a : a + PAIRS_AT_ONCE]
            for some in (slice(1, FEW), slice(FEW, None)):
                i = i[(np.abs(table[i, some] - table[i + step, some]) <= radius).all(axis=1)]
            counts[1] += len(i)
            i = i[np.bitwise_count(values[i] ^ values[i + step]) <= radius]
            counts[2] += len(i)
            i = i[parent[i] != parent[i + step]]  # every row's root, brought up to date after each step
            for x in i.tolist():
                rx, ry = root(x), root(x + step)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
                    lefts.append(x)
                    rights.append(x + step)
            while len(i):
                above = parent[parent]
                if (above == parent).all():
                    break
                parent = above
        step += 1
        left = left[reach[left] >= step]
    return values[lefts], values[rights], counts


def met(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`, thinned to a forest per bucket; rows without a and b hold counts of pairs."""
    blocks = table_plan(nodes.count(), radius)

    def by_tables(rows: DataFrame) -> DataFrame:
        """rows (fp) once for each table of `blocks`, keyed by the bits that the table looks at."""
        masks = np.array([sum(((1 << w) - 1) << s for s, w in table) for table in tables_of(blocks, radius)], dtype=np.uint64).view(np.int64).tolist()
        keys = F.transform(F.array(*map(F.lit, masks)), lambda m: F.xxhash64(m, F.col("fp").bitwiseAND(m)))
        return rows.select("fp", F.explode(keys).alias("key")).select("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last bucket so far: it may go on

        def found() -> pa.RecordBatch:
            k, v = (np.concatenate(c) for c in zip(*held, strict=True))
            a, b, counts = bucket_links(k, v.view(np.uint64), radius)
            none = [None] * len(a)
            columns = [[*a.view(np.int64).tolist(), None], [*b.view(np.int64).tolist(), None], *([*none, int(c)] for c in counts)]
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["a", "b", "met", "survived", "linked"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held and k[0] != held[-1][0][-1]:
                yield found()
                held.clear()
            whole = int(np.searchsorted(k, k[-1], side="left"))
            if whole:
                held.append((k[:whole], v[:whole]))
                yield found()
                held.clear()
            held.append((k[whole:], v[whole:]))
        if held:
            yield found()

    left, parts = nodes.select("fp"), []
    while True:
        rows = by_tables(left)
        crowds = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_MOST).select("key")
        if blocks < BLOCKS_MOST:
            crowds = stored(crowds, "simhash-crowds")
        if blocks == BLOCKS_MOST or not crowds.limit(1).count():
            parts.append(rows)
            break
        # Pairs of a crowded bucket meet in finer tables; both of their nodes are in `left`.
        parts.append(rows.join(crowds, "key", "left_anti"))
        left = stored(rows.join(crowds, "key", "left_semi").select("fp").distinct(), "simhash-crowded")
        blocks = min(BLOCKS_MOST, blocks + 2)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, met long, survived long, linked long")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`, enough of them for the components."""
    return met(nodes, radius).where("a is not null").select("a", "b").distinct()


def pair_counts(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """How many pairs of a bucket were met, how many the pivots let through, and how many of those are links (a pair may meet in several tables)."""
    return met(nodes, radius).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "survived", "linked")])


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(node, root): for every node of an edge (a, b) the least node of its component.

    Alternating large-star and small-star rounds (Kiveris et al.): each round links every
    node's neighbours to the least of them; the edges never outnumber those given. Stops
    when a round changes nothing. A node with very many neighbours is one key of the joins:
    its rows are two longs each, and adaptive execution splits a partition that they make
    too large, the other side having one row for it.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = stored(small, label)
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(now)  # the round before has been read for the last time
        if mark == seen:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, now = mark, after


def rooted(rows: DataFrame, low: Column, radius: int = RADIUS) -> DataFrame:
    """fp, low (that aggregate of its rows) and root (never null) of every distinct fingerprint of rows."""
    nodes = stored(rows.groupBy("fp").agg(low.alias("low")), "simhash-nodes")
    roots = stored(components(links(nodes.select("fp"), radius), "simhash-links"), "simhash-roots")
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def components_of(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row of docs."""
    rows = stored(fingerprinted(docs, width), "simhash-fp")
    grouped = rooted(rows, F.min("doc_id"), radius)
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = grouped.join(lows, "root").select("fp", "component_id")
    return rows.join(classes, "fp")


def deduplicate(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs without near-duplicates: of each component the row of the least doc_id stays.

    A component of null ids alone keeps a row too, and documents that share an id but no
    component all stay. Of a component's rows with its least id the first by the text's
    hashes stays; of rows that are equal in id and text, any one.
    """
    # Ids without nulls, so that the keys of grouping, joining and ordering are the same; nulls come last.
    no, known = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    rows = stored(fingerprinted(docs, width, keep_hashes=True), "simhash-fp").select("fp", F.struct(no.alias("_sim_no"), known.alias("_sim_id"), F.col("h1").alias("_sim_h1"), F.col("h2").alias("_sim_h2")).alias("key"))
    first = rooted(rows, F.min("key"), radius).groupBy("root").agg(F.min("low").alias("low")).select("low.*")
    plain, text, doc_id = numbered(docs), f"c{place_of(docs, 'text')}", f"c{place_of(docs, 'doc_id')}"
    marks = [F.col(doc_id).isNull().alias("_sim_no"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long")).alias("_sim_id"), *(h.alias(n) for h, n in zip(text_hashes(text), ("_sim_h1", "_sim_h2"), strict=True))]
    # Copies of one row are one before they meet anything: grouped where they lie, then by key.
    once = plain.select("*", *marks).dropDuplicates(first.columns)
    return once.join(first, first.columns, "left_semi").select(*plain.columns).toDF(*docs.columns)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = components_of(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
