"""Labels of windows: 1 ahead of an event, -1 (ignored) after one, else 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranges import join_range
from millrace.schema import require

IGNORED, NEGATIVE, POSITIVE = -1, 0, 1
#: Slack of the join's range; the exact conditions decide.
SLACK = 1e-6


def label_windows(windows: DataFrame, events: DataFrame, positive_horizon_s: float = 2.0, post_event_exclusion_s: float = 1.0) -> DataFrame:
    """windows with label, event_peak_time and time_to_event_s.

    The earliest event of the run with 0 <= detection - peak <= exclusion makes a window
    ignored; failing that, the earliest with 0 < peak - detection <= horizon makes it
    positive. Events meet windows by run, chunk of time and range in one left join.
    """
    if positive_horizon_s <= 0:
        raise ValueError("The positive horizon has to be longer than 0 seconds.")
    if post_event_exclusion_s < 0:
        raise ValueError("The exclusion after an event has to be 0 seconds or more.")
    require(windows, {"run_name", "detection_time"}, "columns")
    keys = list(windows.columns)
    peaks = events.select("run_name", F.col("peak_time").alias("peak"))
    at = F.col("detection_time")
    low, high = at - (post_event_exclusion_s + SLACK), at + (positive_horizon_s + SLACK)
    after, ahead = at - F.col("peak"), F.col("peak") - at
    # A row id keeps equal windows apart; it only has to differ within this query.
    numbered = windows.withColumn("row", F.monotonically_increasing_id())
    found = (
        join_range(peaks, "peak", numbered, low, high, F.col("peak").between(low, high), (windows, "detection_time"), "left")
        .groupBy("row", *keys)
        .agg(F.min(F.when((after >= 0) & (after <= post_event_exclusion_s), F.col("peak"))).alias("past"), F.min(F.when((ahead > 0) & (ahead <= positive_horizon_s), F.col("peak"))).alias("next"))
    )
    label = F.when(F.col("past").isNotNull(), F.lit(IGNORED)).when(F.col("next").isNotNull(), F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE))
    until = F.when(F.col("past").isNotNull(), -(at - F.col("past"))).otherwise(F.col("next") - at)
    return found.select(*keys, label.cast("int").alias("label"), F.coalesce("past", "next").alias("event_peak_time"), until.alias("time_to_event_s"))


def label_features(features: DataFrame, events: DataFrame, positive_horizon_s: float = 2.0, post_event_exclusion_s: float = 1.0) -> DataFrame:
    """label_windows over a feature table; a window whose end is not its detection time raises when it is read."""
    require(features, {"run_name", "window_start", "window_end", "detection_time"}, "columns")
    unlike = F.raise_error(F.lit("a window ends at another time than it is detected")).cast("double")
    checked = features.withColumn("detection_time", F.when(F.col("window_end") == F.col("detection_time"), F.col("detection_time")).otherwise(unlike))
    return label_windows(checked, events, positive_horizon_s, post_event_exclusion_s)


def without_ignored(table: DataFrame) -> DataFrame:
    return table.where(F.col("label") != IGNORED)


def label_counts(labeled: DataFrame) -> DataFrame:
    return labeled.groupBy("run_name").agg(F.count_if(F.col("label") == POSITIVE).alias("n_positive"), F.count_if(F.col("label") == NEGATIVE).alias("n_negative"), F.count_if(F.col("label") == IGNORED).alias("n_ignored"))
