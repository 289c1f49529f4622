"""The driver's event stream as sampled runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schema import with_positions

#: 2024-01-01 00:00:00 UTC in microseconds: where run time starts.
EPOCH_US = 1_704_067_200_000_000


def events_as_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for every user; five channels and a status from each event's columns.

    Only the columns used reach the scan. `props` is never read.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / F.lit(1e6)
    on = F.col("event_type") != "error"
    rows = events.select(
        F.col("user_id").cast("string").alias("run_name"),
        seconds.cast("double").alias("time_s"),
        (F.col("value") - 100.0).alias("Sensor1"),
        ((F.col("event_id") % 17) * F.lit(0.5)).alias("VehicleSpeed"),
        (F.col("event_id") % 23).cast("double").alias("CutLength"),
        F.col("value").alias("VoltageSignal"),
        F.when(on, " On ").otherwise("Off").alias("Status"),
        on.alias("HeaderOn"),
        "event_id",
    )
    return with_positions(rows, "event_id")


def scores_of(signals: DataFrame) -> DataFrame:
    """run_name, detection_time and a reproducible score for every sample."""
    return signals.select("run_name", F.col("time_s").alias("detection_time"), (((F.col("event_id") * 7919) % 1000) / F.lit(1000.0)).alias("score"))
