"""Operating episodes: runs of consecutive header-on samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.schema import DEFAULT, ChannelSchema


def episodes(signals: DataFrame, schema: ChannelSchema = DEFAULT, min_duration_s: float = 0.1, grace_s: float = 2.0, fix_leading_on: bool = False) -> DataFrame:
    """run_name, episode_ix (from 0, by end), start_time, end_time, extended_end_time.

    An episode starts at its first On sample and ends at the first Off sample after it, or
    at the run's last sample. Rising and falling edges alternate, so an episode's end is the
    edge that follows its start and one window over the edges pairs them.

    In a run that begins On the compatible rule gives every later episode the start of the
    one before it; fix_leading_on takes each episode's own start. The length limit applies
    to the resulting interval.
    """
    if schema.header_on not in signals.columns:
        raise ValueError(f"No header channel {schema.header_on}")
    run = Window.partitionBy("run_name")
    by_pos = run.orderBy("pos")
    on = F.col(schema.header_on)
    edges = (
        signals.select("run_name", "pos", "time_s", on.alias("on"))
        .withColumn("was_on", F.lag("on", 1, False).over(by_pos))
        .withColumn("last_time", F.max("time_s").over(run))
        .withColumn("first_on", F.min_by("on", "pos").over(run))
        .where(F.col("on") != F.col("was_on"))
    )
    paired = edges.withColumn("end_time", F.coalesce(F.lead("time_s").over(by_pos), F.col("last_time"))).withColumn("end_pos", F.lead("pos").over(by_pos)).where("on")
    start = F.col("time_s")
    if not fix_leading_on:
        start = F.when(F.col("first_on"), F.coalesce(F.lag("time_s").over(by_pos), start)).otherwise(start)
    kept = paired.withColumn("start_time", start).where(F.col("end_time") - F.col("start_time") >= min_duration_s)
    return kept.select(
        "run_name",
        (F.row_number().over(by_pos) - 1).cast("int").alias("episode_ix"),
        "start_time",
        "end_time",
        F.least(F.col("end_time") + grace_s, F.col("last_time")).alias("extended_end_time"),
    )


def whole_runs(signals: DataFrame) -> DataFrame:
    """One episode for each run, over all of it."""
    return signals.groupBy("run_name").agg(F.min("time_s").alias("start_time"), F.max("time_s").alias("end_time")).select("run_name", F.lit(0).alias("episode_ix"), "start_time", "end_time", F.col("end_time").alias("extended_end_time"))


def region_end(region: str) -> Column:
    """The column that ends the evaluated region: "header-on" or "extended"."""
    if region not in ("header-on", "extended"):
        raise ValueError(f"Windows have no region {region}")
    return F.col("end_time" if region == "header-on" else "extended_end_time")


def evaluated_durations(found: DataFrame, region: str = "header-on") -> DataFrame:
    """run_name and the summed seconds of its episodes, short ones included."""
    return found.groupBy("run_name").agg(F.sum(region_end(region) - F.col("start_time")).alias("evaluated_duration_s"))
