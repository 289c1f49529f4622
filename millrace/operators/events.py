"""Reference events: episode-local quantile threshold, gap grouping, peaks, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranges import join_range
from millrace.schema import DEFAULT, ChannelSchema, require


def number(x: Column) -> Column:
    """NaN as null: a measurement that is not a number passes no threshold."""
    return F.nanvl(x, F.lit(None).cast("double"))


def gap_groups(samples: DataFrame, keys: list[str], min_gap_s: float) -> DataFrame:
    """samples (keys, time_s) with group_ix: a new group where the time since the last exceeds min_gap_s."""
    if min_gap_s < 0:
        raise ValueError("The gap between groups has to be 0 seconds or more.")
    order = Window.partitionBy(*keys).orderBy("time_s")
    new = F.coalesce((F.col("time_s") - F.lag("time_s").over(order) > min_gap_s).cast("int"), F.lit(0))
    return samples.withColumn("new_group", new).withColumn("group_ix", F.sum("new_group").over(order)).drop("new_group")


def peak_ratio(peak: Column, threshold: Column) -> Column:
    return F.when(threshold == 0, F.lit(float("inf"))).otherwise(peak / F.when(threshold != 0, threshold))


def with_ratio(events: DataFrame) -> DataFrame:
    """events with duration_s and peak_to_threshold_ratio."""
    return events.withColumn("duration_s", F.col("end_time") - F.col("start_time")).withColumn("peak_to_threshold_ratio", peak_ratio(F.col("peak_voltage"), F.col("threshold")))


def candidates(signals: DataFrame, episodes: DataFrame, quantile: float, schema: ChannelSchema = DEFAULT) -> DataFrame:
    """Samples over their episode's quantile, with that threshold.

    Episodes are few beside samples: Catalyst broadcasts them where their measured size
    allows and else joins by run and chunk of time, so no broadcast is forced here.
    """
    if not 0 <= quantile <= 1:
        raise ValueError("A quantile lies between 0 and 1.")
    samples = signals.select("run_name", "time_s", number(F.col(schema.voltage)).alias("voltage"))
    bounds = episodes.select("run_name", "episode_ix", F.col("start_time").alias("episode_start_time"), F.col("end_time").alias("episode_end_time"), "extended_end_time")
    start, end = F.col("episode_start_time"), F.col("extended_end_time")
    inside = join_range(samples, "time_s", bounds, start, end, F.col("time_s").between(start, end), (samples, "time_s"))
    # A window, not an aggregate joined back: the samples are joined and dealt out once, and the
    # grouping by gaps that follows finds them partitioned as it needs.
    level = F.percentile("voltage", F.lit(quantile)).over(Window.partitionBy("run_name", "episode_ix"))
    return inside.withColumn("threshold", level).where(F.col("voltage") > F.col("threshold"))


def detect_events(
    signals: DataFrame,
    episodes: DataFrame,
    threshold_quantile: float = 0.999,
    min_gap_s: float = 0.5,
    min_duration_s: float = 0.01,
    schema: ChannelSchema = DEFAULT,
    deduplicate: bool = True,
    duplicate_tolerance_s: float = 0.001,
) -> DataFrame:
    """Events of every run and episode, with the channel they come from as source; the peak is the first of a group's greatest samples.

    What lies between a group's first and last candidate without being one is below the
    threshold, so the group's candidates hold its peak.
    """
    over = gap_groups(candidates(signals, episodes, threshold_quantile, schema), ["run_name", "episode_ix"], min_gap_s)
    found = (
        over.groupBy("run_name", "episode_ix", "group_ix")
        .agg(
            F.min("time_s").alias("start_time"),
            F.min_by("time_s", F.struct(-F.col("voltage"), F.col("time_s"))).alias("peak_time"),
            F.max("time_s").alias("end_time"),
            F.max("voltage").alias("peak_voltage"),
            F.first("threshold").alias("threshold"),
            F.first("episode_start_time").alias("episode_start_time"),
            F.first("episode_end_time").alias("episode_end_time"),
        )
        .where(F.col("end_time") - F.col("start_time") >= min_duration_s)
        .withColumn("source", F.lit(schema.voltage))
    )
    if deduplicate:
        found = dedup_events(found, duplicate_tolerance_s)
    return with_ratio(found.drop("group_ix"))


def dedup_events(events: DataFrame, tolerance_s: float = 0.001) -> DataFrame:
    """One event for each run and rounded peak time: nearest to its episode's end, then strongest.

    Peaks meet in buckets of half-even rounded time, not by distance.
    """
    if tolerance_s <= 0:
        raise ValueError("Peaks need a tolerance above 0 seconds.")
    order = Window.partitionBy("run_name", F.rint(F.col("peak_time") / tolerance_s)).orderBy(
        F.abs(F.col("peak_time") - F.col("episode_end_time")), peak_ratio(F.col("peak_voltage"), F.col("threshold")).desc(), F.col("peak_voltage").desc(), "episode_ix", "start_time"
    )
    return events.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def filter_by_ratio(events: DataFrame, min_ratio: float) -> DataFrame:
    if min_ratio < 0:
        raise ValueError("The least ratio has to be 0 or more.")
    return events.where(F.col("peak_to_threshold_ratio") >= min_ratio)


def audit(events: DataFrame) -> DataFrame:
    """events with event_index (from 1, by peak), time from the episode's end to the peak, and whether it is inside."""
    order = Window.partitionBy("run_name").orderBy("peak_time", "start_time")
    return (
        events.withColumn("event_index", F.row_number().over(order))
        .withColumn("time_from_episode_end_to_peak", F.col("peak_time") - F.col("episode_end_time"))
        .withColumn("inside_header_on_episode", F.col("peak_time") <= F.col("episode_end_time"))
    )


def audit_summary(audited: DataFrame, min_ratio: float = 1.0) -> DataFrame:
    """Per run and overall (null run_name): counts and the spread of the ratio, in one rollup."""
    ratio = F.col("peak_to_threshold_ratio")
    return audited.rollup("run_name").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min(ratio).alias("min_ratio"),
        F.median(ratio).alias("median_ratio"),
        F.max(ratio).alias("max_ratio"),
        F.count_if(F.col("inside_header_on_episode")).alias("n_inside"),
        F.count_if(ratio >= min_ratio).alias("n_strong"),
    )


def weakest(audited: DataFrame, n: int = 10) -> DataFrame:
    """The n events of least ratio: a report, so its limit is the feature."""
    return audited.orderBy("peak_to_threshold_ratio", "run_name", "peak_time").limit(n)


def with_recent_header(signals: DataFrame, lookback_s: float, schema: ChannelSchema = DEFAULT) -> DataFrame:
    """signals with recently_on: whether any sample of [time_s - lookback_s, time_s] is On."""
    frame = f"partition by run_name order by time_s range between {float(lookback_s)!r}D preceding and current row"
    return signals.withColumn("recently_on", F.expr(f"max(cast(`{schema.header_on}` as int)) over ({frame}) = 1"))


def to_evaluation_table(events: DataFrame) -> DataFrame:
    """The columns that matching and evaluation read."""
    return events.select("run_name", "peak_time", "peak_voltage", "threshold", "peak_to_threshold_ratio")


def metadata_to_events(metadata: DataFrame) -> DataFrame:
    """Generator metadata as point events with threshold 1, so that the ratio is the amplitude."""
    require(metadata, {"run_name", "event_time", "amplitude"}, "metadata columns")
    at = F.col("event_time").cast("double")
    return metadata.select(
        "run_name",
        at.alias("start_time"),
        at.alias("peak_time"),
        at.alias("end_time"),
        F.col("amplitude").cast("double").alias("peak_voltage"),
        F.lit(1.0).alias("threshold"),
        at.alias("episode_start_time"),
        at.alias("episode_end_time"),
        F.lit("synthetic_metadata").alias("source"),
    )
