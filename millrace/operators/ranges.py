"""Joins of a run's points with its intervals, keyed by chunks of time.

A join on the run and a range would leave a long run to one task, and meet all of its
points with all of its intervals there. Time is cut into chunks that hold CHUNK_ROWS rows
of the denser table on average; points lie in one chunk, intervals in as many as they
touch, and the join is keyed by (run, chunk), with the exact range as what remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the denser table in a chunk, about.
CHUNK_ROWS = 4096


def chunks(dense: DataFrame, time: str) -> DataFrame:
    """run_name with where its chunks start, how long they are and how many there are: one row a run."""
    spans = dense.groupBy("run_name").agg(F.min(time).alias("chunk_from"), F.max(time).alias("chunk_to"), F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).alias("n_chunks"))
    length = (F.col("chunk_to") - F.col("chunk_from")) / F.col("n_chunks")
    return spans.select("run_name", "chunk_from", F.when(length > 0, length).otherwise(F.lit(1.0)).alias("chunk_s"), "n_chunks")


def join_range(points: DataFrame, point: str, intervals: DataFrame, low: Column, high: Column, exact: Column, dense: tuple[DataFrame, str], how: str = "inner") -> DataFrame:
    """points and intervals of a run for which `exact` holds; all points of an interval lie in [low, high].

    Columns of both but one run_name. how="left" keeps intervals without points; such an
    interval has a row without a point for every chunk it touches, so group by it.
    """
    spans = chunks(*dense)

    def chunk(t: Column) -> Column:
        """Rises with t, and is the same on both sides."""
        return F.greatest(F.lit(0), F.least(F.floor((t - F.col("chunk_from")) / F.col("chunk_s")), F.col("n_chunks"))).cast("long")

    held = points.join(spans, "run_name").withColumn("chunk", chunk(F.col(point))).drop(*spans.columns[1:]).withColumnRenamed("run_name", "point_run").withColumnRenamed("chunk", "point_chunk")
    touched = F.explode_outer(F.sequence(chunk(low), F.greatest(chunk(low), chunk(high))))
    spread = intervals.join(spans, "run_name", "left").withColumn("chunk", touched).drop(*spans.columns[1:])
    met = spread.join(held, (F.col("run_name") == F.col("point_run")) & (F.col("chunk") == F.col("point_chunk")) & exact, how)
    return met.drop("point_run", "point_chunk", "chunk")
