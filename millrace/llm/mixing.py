"""Mixing sources to target weights, with DataFrame functions only.

Weighted sampling without replacement by exponential keys (Efraimidis and Spirakis):
a document of quality weight q draws u in (0, 1) from a hash of its id and gets the
key -ln(u) / q. Documents of a source are taken in the order of their keys until the
source's budget of words is spent. A budget over the source's size takes every
document once per complete epoch first; only the rest is selected by key.

A source may hold a third of all rows, so no source is sorted in one task. The keys
map monotonically onto slices of (0, 1), KEY_BUCKETS of them or more, so that a slice
holds SLICE_ROWS rows at most on average; sums per (source, slice) give each slice its
offset, and rows are sorted within their slice alone. What is sorted are ids, keys and
sizes. From them every source gets its number of epochs and the row on which its budget
ends: `mix` reads the texts once more, compares each row's key with that of its source's
last row, and never shuffles a text.

Defined cases. Null text: size 0, never taken. Null source: a source of its own, last
in the order. Null doc_id: hashed as the empty string. Repeated rows: each counts and
is taken on its own (only where a budget ends within rows of equal id and text are
those numbered, in one task a source); ties of keys go by doc_id, then by the text's
hash. Empty table: no rows. `mix` carries other columns, whatever their names, along
untouched; what `sized` and `allocate` add starts with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, numbered, place_of, stored

#: Slices of the key space per source, at least, and the rows of a slice, about.
KEY_BUCKETS, SLICE_ROWS = 1024, 1 << 16
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: All targets together, as a share of all sizes.
SHARE = 1.5
#: No source and no document is taken more often than this.
MOST_EPOCHS = 2.0
#: Characters that rarely belong to prose; their share lowers a document's quality weight.
ODD = "0123456789<>{}[]|/_=*#@%&~^"


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """A weight in (0, 1]: the share of ordinary characters, raised to 0.05 at least."""
    n = F.length(text)
    odd = n - F.length(F.translate(text, ODD, ""))
    return F.when(n > 0, F.lit(1.0) - F.lit(0.95) * odd / n).otherwise(F.lit(1.0))


def slices_for(rows: int) -> int:
    """Slices for a table of so many rows, all of which may be of one source."""
    return max(KEY_BUCKETS, rows // SLICE_ROWS)


def sized(docs: DataFrame, slices: int = KEY_BUCKETS) -> DataFrame:
    """docs with the size, the sampling key and the key's slice of every row."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), name)), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    return (
        docs.withColumn("_mix_size", size_of(F.col("text")))
        .withColumn("_mix_key", -F.log(u) / quality_of(F.col("text")))
        .withColumn("_mix_slice", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("_mix_key"))) * slices), F.lit(slices - 1)).cast("int"))
        .withColumn("_mix_tie", F.xxhash64("text"))
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Per source its target; sizes has _mix_source and _mix_source_size, one row a source.

    Sources whose cap is lowest for their weight are filled first; what is left is
    shared by weight among the others at one common level, which is where repeated
    resharing of the excess ends.
    """
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("_mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("_mix_source_size") * F.lit(float(most))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("_mix_cap") / F.col("_mix_w"), F.col("_mix_source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    left = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    right = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (
        sizes.withColumn("_mix_w", weight)
        .withColumn("_mix_cap", cap)
        .withColumn("_mix_rest", F.sum("_mix_source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_mix_cap").over(left), F.lit(0.0)))
        .withColumn("_mix_level", F.col("_mix_rest") / F.sum("_mix_w").over(right))
        .withColumn("_mix_open", F.col("_mix_cap") > F.col("_mix_level") * F.col("_mix_w"))
        .withColumn("_mix_level", F.min_by(F.when(F.col("_mix_open"), F.col("_mix_level")), F.when(F.col("_mix_open"), F.col("_mix_cap") / F.col("_mix_w"))).over(everything))
    )
    return filled.select("_mix_source", "_mix_source_size", F.coalesce(F.least("_mix_cap", F.col("_mix_level") * F.col("_mix_w")), F.col("_mix_cap")).alias("_mix_target"))


def allocate(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """rows, as sized() gives them, with _mix_source_size, _mix_target and _mix_taken (words taken, repeats counted)."""
    slices = rows.groupBy(F.col("source").alias("_mix_source"), "_mix_slice").agg(F.sum("_mix_size").alias("_mix_sum"))
    goals = targets(slices.groupBy("_mix_source").agg(F.sum("_mix_sum").alias("_mix_source_size")), weights, share, most)
    before = Window.partitionBy("_mix_source").orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("_mix_offset", F.coalesce(F.sum("_mix_sum").over(before), F.lit(0))).drop("_mix_sum")
    plan = offsets.withColumnRenamed("_mix_source", "_mix_s").join(goals, F.col("_mix_s").eqNullSafe(F.col("_mix_source"))).drop("_mix_s").withColumnRenamed("_mix_slice", "_mix_of")
    inner = Window.partitionBy("source", "_mix_slice").orderBy("_mix_key", F.col("doc_id").asc_nulls_last(), "_mix_tie", "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each source and slice: small beside the documents, but never assumed to fit a broadcast.
    joined = rows.withColumn("_mix_inner", F.coalesce(F.sum("_mix_size").over(inner), F.lit(0))).join(
        plan, rows["source"].eqNullSafe(F.col("_mix_source")) & (F.col("_mix_slice") == F.col("_mix_of"))
    )
    whole = F.when(F.col("_mix_source_size") > 0, F.floor(F.col("_mix_target") / F.col("_mix_source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("_mix_target") - F.col("_mix_epochs") * F.col("_mix_source_size")).cast("long")
    part = F.least(F.col("_mix_size"), F.greatest(F.lit(0).cast("long"), rest - F.col("_mix_offset") - F.col("_mix_inner")))
    return joined.withColumn("_mix_epochs", whole).withColumn("_mix_part", part).withColumn("_mix_taken", F.col("_mix_epochs") * F.col("_mix_size") + F.col("_mix_part"))


def slim(docs: DataFrame) -> DataFrame:
    """Ids, sources, sizes and keys of docs, stored: what is allocated, without the texts."""
    rows = sized(docs, slices_for(docs.count()))
    return stored(rows.select("doc_id", "source", *[c for c in rows.columns if c.startswith("_mix_")]), "mix-sizes")


def _place() -> Column:
    """A row's place in its source's order, as a struct that compares."""
    return F.struct(F.col("_mix_key").alias("key"), F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("_mix_tie").alias("tie"))


def ends(taken: DataFrame) -> DataFrame:
    """Per source: its epochs, the last row that the rest of its budget takes (null: none), that row's part, and how many rows equal it."""
    last = taken.groupBy(F.col("source").alias("_mix_s")).agg(F.first("_mix_epochs").alias("_mix_epochs"), F.max(F.when(F.col("_mix_part") > 0, _place())).alias("_mix_last"))
    equal = taken.select("source", _place().alias("_mix_place"), "_mix_part").join(last.select("_mix_s", "_mix_last"), F.col("source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_place") == F.col("_mix_last")))
    parts = equal.groupBy(F.col("source").alias("_mix_p")).agg(F.sum("_mix_part").alias("_mix_sum"), F.count(F.lit(1)).alias("_mix_times"))
    return last.join(parts, F.col("_mix_s").eqNullSafe(F.col("_mix_p")), "left").drop("_mix_p")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """The mixed documents: a row for each time that a document is taken, with the columns of docs.

    The one document of a source on which its budget ends keeps its first words only;
    its n_chars, where there is such a column, follows its text.
    """
    plain = numbered(docs)
    column = {n: F.col(f"c{place_of(docs, n)}") for n in ("text", "doc_id", "source")}
    named = plain.select("*", *[c.alias(n) for n, c in column.items()])
    taken = stored(allocate(slim(named.select(*column)), weights, share, most).drop("_mix_slice", "_mix_source"), "mix-taken")
    bounds = stored(ends(taken), "mix-ends")
    # One row a source; Catalyst broadcasts it while it is small.
    rows = sized(named).drop("_mix_slice").join(bounds, F.col("source").eqNullSafe(F.col("_mix_s"))).withColumn("_mix_place", _place())
    # Copies of the row on which the budget ends: whole ones first, then the cut one.
    equal = F.coalesce(F.col("_mix_place")["id"].eqNullSafe(F.col("_mix_last")["id"]) & F.col("_mix_place")["tie"].eqNullSafe(F.col("_mix_last")["tie"]) & F.col("_mix_last").isNotNull(), F.lit(False))
    before = F.coalesce(F.col("_mix_place") < F.col("_mix_last"), F.lit(False))
    rows = rows.withColumn("_mix_equal", equal)
    if bounds.where("_mix_times > 1").isEmpty():
        rows = rows.withColumn("_mix_nth", F.lit(1))
    else:
        nth = F.row_number().over(Window.partitionBy("_mix_s").orderBy(F.lit(0)))
        rows = rows.where("not _mix_equal").withColumn("_mix_nth", F.lit(1)).unionByName(rows.where("_mix_equal").withColumn("_mix_nth", nth))
    rest = F.greatest(F.lit(0), F.least(F.col("_mix_size"), F.col("_mix_sum") - (F.col("_mix_nth") - 1) * F.col("_mix_size")))
    part = F.when(F.col("_mix_equal"), rest).when(before, F.col("_mix_size")).otherwise(F.lit(0)).cast("long")
    times = F.when(F.col("_mix_size") > 0, F.col("_mix_epochs") + (F.col("_mix_part") > 0).cast("long"))
    # An outer explode: from an inner one Catalyst infers a filter ahead of it that counts the words once more.
    copies = (
        rows.withColumn("_mix_part", part)
        .withColumn("_mix_times", times)
        .withColumn("_mix_copy", F.explode_outer(F.when(F.col("_mix_times") > 0, F.sequence(F.lit(1).cast("long"), F.col("_mix_times")))))
        .where("_mix_copy is not null")
    )
    cut = (F.col("_mix_copy") > F.col("_mix_epochs")) & (F.col("_mix_part") < F.col("_mix_size"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    left = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("_mix_part").cast("int")), "")).otherwise(F.col("text"))
    copies = copies.withColumn("_mix_text", left)
    out = []
    for i in range(len(docs.columns)):
        if i == place_of(docs, "text"):
            out.append(F.col("_mix_text").alias(f"c{i}"))
        elif i == place_of(docs, "n_chars"):
            out.append(F.when(cut, F.length("_mix_text")).otherwise(F.col(f"c{i}")).cast(plain.schema[i].dataType).alias(f"c{i}"))
        else:
            out.append(F.col(f"c{i}"))
    return copies.select(*out).toDF(*docs.columns)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return allocate(slim(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").cast("double").alias("target"),
        F.col("_mix_taken").alias("taken"),
    )


OP1_SQL = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, length(text) AS n,
         length(text) - length(translate(text, '0123456789<>{}[]|/_=*#@%&~^', '')) AS odd,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
keyed AS (
  SELECT *, -ln(u) / (CASE WHEN n > 0 THEN 1.0::DOUBLE - 0.95::DOUBLE * odd / n ELSE 1.0::DOUBLE END) AS k FROM docs),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, source_size * 2.0::DOUBLE AS cap FROM sizes),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM weighed),
goal AS (
  SELECT source, source_size, coalesce(least(cap, w * (SELECT arg_min(lv, cap / w) FROM levels WHERE cap > lv * w)), cap) AS target FROM levels),
summed AS (
  SELECT k.*, g.source_size, g.target,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
         CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM keyed k JOIN goal g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, CAST(floor(target - epochs * source_size) AS BIGINT) - ahead)) AS BIGINT) AS taken
FROM summed
"""
