"""Window features: time domain in SQL aggregates, spectrum in Arrow batches, past-only deltas."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType, StructField, StructType

from millrace.functions.spectrum import BANDS, spectral_names, spectral_table
from millrace.operators.windows import window_samples
from millrace.schema import DEFAULT, ChannelSchema, require

#: A window's keys, in the order of the feature table.
KEYS = ("run_name", "episode_ix", "window_ix", "window_start", "window_end", "detection_time", "start_index", "end_index")
#: Numeric columns that are no measurements: they get no delta and are no model input.
NO_DELTA = frozenset(("episode_ix", "window_ix", "window_start", "window_end", "detection_time", "start_index", "end_index", "label", "event_peak_time", "time_to_event_s"))


@dataclass(frozen=True)
class FeatureConfig:
    bands_hz: tuple[tuple[float, float], ...] = BANDS
    use_spectrum: bool = True


def negative_sign(x: Column) -> Column:
    """The sign bit: true for -0.0, which no comparison tells from 0.0."""
    return F.startswith(x.cast("string"), F.lit("-"))


def time_features(signals: DataFrame, windows: DataFrame, schema: ChannelSchema = DEFAULT) -> DataFrame:
    """windows with sample rate, audio statistics and, where the channels exist, context statistics.

    Steps and sign changes are worked out once per sample over its run; within a window
    those of the first sample are left out. Everything is then one grouped aggregate.
    """
    order = Window.partitionBy("run_name").orderBy("pos")
    x = F.col(schema.sensor).cast("double")
    context = [c for c in (schema.vehicle_speed, schema.cut_length) if c in signals.columns]
    marked = signals.select(
        "run_name", "pos", "time_s", x.alias("x"), *context, (F.col("time_s") - F.lag("time_s").over(order)).alias("step"), (negative_sign(x) != negative_sign(F.lag(x).over(order))).cast("int").alias("flip")
    )
    rows = window_samples(marked, windows)
    later = F.col("pos") > F.col("start_index")
    step = F.when(later & (F.col("step") > 0), F.col("step"))
    grouped = rows.groupBy(*KEYS).agg(
        F.percentile(step, F.lit(0.5)).alias("median_step"),
        F.avg("x").alias("audio_mean"),
        F.stddev_pop("x").alias("audio_std"),
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("audio_rms"),
        F.max(F.abs("x")).alias("audio_peak_abs"),
        F.sum(F.when(later, F.col("flip")).otherwise(0)).alias("flips"),
        F.count(F.lit(1)).alias("n"),
        (F.max("time_s") - F.min("time_s")).alias("seconds"),
        *[f(F.col(c)).alias(f"{c}_{n}") for c in context for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
    )
    rate = F.when(F.col("median_step") > 0, F.lit(1.0) / F.col("median_step")).otherwise(F.lit(0.0))
    crest = F.when(F.col("audio_rms") > 0, F.col("audio_peak_abs") / F.col("audio_rms")).otherwise(F.lit(0.0))
    crossings = F.when((F.col("n") >= 2) & (F.col("seconds") > 0), F.col("flips") / F.col("seconds")).otherwise(F.lit(0.0))
    return grouped.select(
        *KEYS,
        rate.alias("sample_rate_hz"),
        "audio_mean",
        "audio_std",
        "audio_rms",
        "audio_peak_abs",
        crest.alias("audio_crest_factor"),
        crossings.alias("audio_zero_crossing_rate"),
        *[f"{c}_{n}" for c in context for n in ("mean", "std")],
    )


def window_arrays(signals: DataFrame, windows: DataFrame, schema: ChannelSchema = DEFAULT) -> DataFrame:
    """windows with `audio`: the samples of each in order. A window is bounded, so is its array."""
    rows = window_samples(signals.select("run_name", "pos", F.col(schema.sensor).cast("double").alias("x")), windows)
    keys = [c for c in windows.columns]
    sorted_ = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("s"))
    return sorted_.select(*keys, F.transform("s", lambda s: s["x"]).alias("audio"))


def spectral_features(arrays: DataFrame, rate: str = "sample_rate_hz", bands: tuple[tuple[float, float], ...] = BANDS) -> DataFrame:
    """arrays (with `audio` and the rate column) with band shares, centroid, bandwidth and high-frequency share in place of `audio`."""
    names, kept = spectral_names(bands), [c for c in arrays.columns if c != "audio"]
    schema = StructType([*[arrays.schema[c] for c in kept], *[StructField(n, DoubleType()) for n in names]])
    places, audio, at = [arrays.columns.index(c) for c in kept], arrays.columns.index("audio"), arrays.columns.index(rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(audio)
            sizes = np.array([n or 0 for n in column.value_lengths().to_pylist()], dtype=np.int64)
            values = spectral_table(column.flatten().to_numpy(zero_copy_only=False), sizes, batch.column(at).to_numpy(zero_copy_only=False), bands)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], *[pa.array(v) for v in values.T]], names=[*kept, *names])

    return arrays.mapInArrow(run, schema)


def feature_table(signals: DataFrame, windows: DataFrame, schema: ChannelSchema = DEFAULT, config: FeatureConfig = FeatureConfig()) -> DataFrame:  # noqa: B008
    """A row of features for every window: rate, audio, spectrum, context."""
    timed = time_features(signals, windows, schema)
    if not config.use_spectrum:
        return timed
    keys = ["run_name", "episode_ix", "window_ix"]
    arrays = window_arrays(signals, windows.select(*keys, "start_index", "end_index"), schema).drop("start_index", "end_index")
    joined = timed.join(arrays, keys)
    spectral = spectral_features(joined, "sample_rate_hz", config.bands_hz)
    context = [c for c in timed.columns if c not in KEYS and not c.startswith("audio_") and c != "sample_rate_hz"]
    audio = [c for c in timed.columns if c.startswith("audio_")]
    return spectral.select(*KEYS, "sample_rate_hz", *audio, *spectral_names(config.bands_hz), *context)


def numeric_columns(table: DataFrame, without: frozenset[str] = NO_DELTA) -> list[str]:
    """Numeric columns in order, but those named in `without`."""
    return [f.name for f in table.schema.fields if isinstance(f.dataType, NumericType) and f.name not in without]


def temporal_deltas(table: DataFrame, group: str = "run_name", order: str = "detection_time", lag: int = 1, suffix: str | None = None) -> DataFrame:
    """table with x - x `lag` windows earlier for every numeric feature; null and NaN become 0."""
    require(table, {group}, "group column")
    require(table, {order}, "order column")
    if lag <= 0:
        raise ValueError("Deltas look at least one window back.")
    suffix = suffix or f"delta_{lag}"
    ties = [c for c in ("episode_ix", "window_ix") if c in table.columns]
    past = Window.partitionBy(group).orderBy(order, *ties)

    def delta(c: str) -> Column:
        d = F.col(c).cast("double") - F.lag(F.col(c).cast("double"), lag).over(past)
        return F.coalesce(F.nanvl(d, F.lit(None).cast("double")), F.lit(0.0)).alias(f"{c}_{suffix}")

    return table.select("*", *[delta(c) for c in numeric_columns(table) if not c.endswith(f"_{suffix}")])
