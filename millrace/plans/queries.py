"""Queries over the driver's tables: each composes operators at parameters that suit the event stream's days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.spectrum import SpectrogramConfig
from millrace.operators import alarms, events, features, forest, greedy, labels, spectrograms, status, windows
from millrace.operators.episodes import episodes, evaluated_durations, whole_runs
from millrace.sources.files import resample
from millrace.sources.tables import events_as_signals, scores_of

DAY = 86400.0
GRACE_S, GAP_S, WINDOW_S, HOP_S, QUANTILE = DAY, DAY / 2, 4 * DAY, DAY, 0.9
HORIZON_S, EXCLUSION_S, REFRACTORY_S, EARLY_S = 2 * DAY, DAY, DAY, 2 * DAY
SWEEP = (0.1, 0.3, 0.5, 0.9)
#: A rate at which the 64 samples of an embedding have bins of a whole number of hertz.
RATE_HZ = 16384.0
#: A fixed forest of two trees over (audio_mean, audio_rms, VehicleSpeed_mean).
FOREST = [
    {"left": [1, 3, -1, -1, -1], "right": [2, 4, -1, -1, -1], "feature": [0, 1, -2, -2, -2], "threshold": [0.5, 90.0, -2.0, -2.0, -2.0], "value": [0.5, 0.3, 0.75, 0.125, 0.5]},
    {"left": [1, -1, -1], "right": [2, -1, -1], "feature": [2, -2, -2], "threshold": [4.0, -2.0, -2.0], "value": [0.5, 0.25, 0.875]},
]
FOREST_FEATURES = ("audio_mean", "audio_rms", "VehicleSpeed_mean")


def rounded(df: DataFrame, places: int = 6, only: dict[str, int] | None = None) -> DataFrame:
    """Doubles to so many places, for comparison between engines."""
    only = only or {}
    return df.select(*[F.round(c, only.get(c, places)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_signals(spark, sf_dir)


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(_signals(spark, sf_dir), grace_s=GRACE_S)


def _events(spark: SparkSession, sf_dir: str, deduplicate: bool = True) -> DataFrame:
    signals = _signals(spark, sf_dir)
    return events.detect_events(signals, episodes(signals, grace_s=GRACE_S), QUANTILE, GAP_S, 0.0, deduplicate=deduplicate)


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = _signals(spark, sf_dir)
    return windows.sliding_windows(signals, episodes(signals, grace_s=GRACE_S), WINDOW_S, HOP_S)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.time_features(_signals(spark, sf_dir), _windows(spark, sf_dir))


def _labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_windows(_windows(spark, sf_dir), _events(spark, sf_dir), HORIZON_S, EXCLUSION_S)


def _alarms(spark: SparkSession, sf_dir: str, thresholds: tuple[float, ...]) -> DataFrame:
    return alarms.suppress(alarms.detections(scores_of(_signals(spark, sf_dir)), thresholds, 2, 3), REFRACTORY_S)


def _matched(spark: SparkSession, sf_dir: str, thresholds: tuple[float, ...]) -> DataFrame:
    return alarms.match(_events(spark, sf_dir), _alarms(spark, sf_dir, thresholds), thresholds, EARLY_S)


def _summary(spark: SparkSession, sf_dir: str, thresholds: tuple[float, ...]) -> DataFrame:
    return rounded(alarms.summarize(_matched(spark, sf_dir, thresholds), evaluated_durations(_episodes(spark, sf_dir)), thresholds))


def normalize_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = status.normalize_status(_signals(spark, sf_dir).drop("HeaderOn"))
    return rows.groupBy("run_name").agg(F.count_if("HeaderOn").alias("n_on"), F.count(F.lit(1)).alias("n_rows"))


def validate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.validation_report(_signals(spark, sf_dir))


def run_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _signals(spark, sf_dir).groupBy("run_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("time_s").alias("start_time"), F.max("time_s").alias("end_time"), F.count_if("HeaderOn").alias("n_on"), F.max("VoltageSignal").alias("max_voltage"), F.avg("Sensor1").alias("sensor_mean")
    )
    return rounded(found)


def sample_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.sample_rates(_signals(spark, sf_dir)), 9)


def episodes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_episodes(spark, sf_dir))


def episodes_own_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(episodes(_signals(spark, sf_dir), grace_s=GRACE_S, fix_leading_on=True))


def evaluated_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluated_durations(_episodes(spark, sf_dir)), 3)


def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = events.gap_groups(_signals(spark, sf_dir).select("run_name", "time_s"), ["run_name"], GAP_S)
    return rounded(groups.groupBy("run_name", "group_ix").agg(F.min("time_s").alias("start_time"), F.max("time_s").alias("end_time"), F.count(F.lit(1)).alias("n_rows")))


def voltage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_events(spark, sf_dir, deduplicate=False))


def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_events(spark, sf_dir).drop("source"))


def ratio_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.to_evaluation_table(events.filter_by_ratio(_events(spark, sf_dir), 1.05)))


def event_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.audit(_events(spark, sf_dir)).drop("source"))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.audit_summary(events.audit(_events(spark, sf_dir)), 1.05))


def weakest_events_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = events.weakest(events.audit(_events(spark, sf_dir)), 10)
    return rounded(kept.select("run_name", "peak_time", "peak_voltage", "threshold", "peak_to_threshold_ratio", "time_from_episode_end_to_peak", "inside_header_on_episode"))


def inspect_run_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = _signals(spark, sf_dir)
    found = events.detect_events(signals, whole_runs(signals), 0.95, GAP_S, 0.0, deduplicate=False).drop("source")
    seen = events.with_recent_header(signals, DAY).select(F.col("run_name").alias("of_run"), F.col("time_s").alias("at"), F.col("HeaderOn").alias("on_at_peak"), "recently_on")
    return rounded(found.join(seen, (F.col("run_name") == F.col("of_run")) & (F.col("peak_time") == F.col("at"))).select("run_name", "start_time", "peak_time", "end_time", "peak_voltage", "threshold", "on_at_peak", "recently_on"))


def recent_header_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.with_recent_header(_signals(spark, sf_dir), DAY)
    return found.groupBy("run_name").agg(F.count_if("recently_on").alias("n_recent"), F.count_if(F.col("recently_on") & ~F.col("HeaderOn")).alias("n_only_recent"))


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_windows(spark, sf_dir))


def windows_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over each episode with its grace period."""
    signals = _signals(spark, sf_dir)
    return rounded(windows.sliding_windows(signals, episodes(signals, grace_s=GRACE_S), WINDOW_S, HOP_S, "extended"))


def timed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = _signals(spark, sf_dir)
    return rounded(windows.timed_windows(signals, episodes(signals, grace_s=GRACE_S), WINDOW_S, HOP_S))


def resampled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run on a grid of six hours."""
    return rounded(resample(_signals(spark, sf_dir), DAY / 4, ["Sensor1", "VoltageSignal"], ["CutLength"]))


def label_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _features(spark, sf_dir).select("run_name", "episode_ix", "window_ix", "window_start", "window_end", "detection_time", "audio_rms")
    found = labels.label_features(table, _events(spark, sf_dir), HORIZON_S, EXCLUSION_S)
    return rounded(found.select("run_name", "episode_ix", "window_ix", "audio_rms", "label", "event_peak_time", "time_to_event_s"))


def window_time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir).drop("VehicleSpeed_mean", "VehicleSpeed_std", "CutLength_mean", "CutLength_std", "window_end"))


def window_context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_features(spark, sf_dir).select("run_name", "episode_ix", "window_ix", "VehicleSpeed_mean", "VehicleSpeed_std", "CutLength_mean", "CutLength_std"))


def temporal_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = features.temporal_deltas(_features(spark, sf_dir).select("run_name", "episode_ix", "window_ix", "detection_time", "audio_rms", "VehicleSpeed_mean"))
    return rounded(table.drop("audio_rms", "VehicleSpeed_mean"))


def label_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_labeled(spark, sf_dir).select("run_name", "episode_ix", "window_ix", "detection_time", "label", "event_peak_time", "time_to_event_s"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_counts(_labeled(spark, sf_dir))


def trainable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.without_ignored(_labeled(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("run_name").alias("n_runs"))


def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forest.balanced_weights(labels.without_ignored(_labeled(spark, sf_dir))))


def consensus_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(alarms.detections(scores_of(_signals(spark, sf_dir)), (0.5,), 2, 3).drop("threshold"))


def refractory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_alarms(spark, sf_dir, (0.5,)).drop("threshold"))


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(alarms.event_matches(_matched(spark, sf_dir, (0.5,))).drop("threshold"))


def false_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(alarms.false_detections(_matched(spark, sf_dir, (0.5,))).drop("threshold"))


def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, (0.5,))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, SWEEP)


def min_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(greedy.thin(_signals(spark, sf_dir).select("run_name", "time_s"), ["run_name"], "time_s", DAY, strict=False))


def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.group_folds(_signals(spark, sf_dir), 5)


def forest_score_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = forest.forest_score(FOREST, [F.col(c) for c in FOREST_FEATURES])
    return _features(spark, sf_dir).select("run_name", "episode_ix", "window_ix", score.alias("score"), forest.predicted(score, 0.5).alias("predicted"))


def forest_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, n, a, b) for i, t in enumerate(FOREST) for n, (a, b) in enumerate(zip(t["left"], t["right"], strict=True))]
    return forest.size_bytes(spark.createDataFrame(rows, "tree_id int, node_id int, left_child int, right_child int"))


def metadata_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir).select("run_name", F.col("time_s").alias("event_time"), F.col("VoltageSignal").alias("amplitude"))
    return rounded(events.with_ratio(events.metadata_to_events(rows)).select("run_name", "peak_time", "peak_voltage", "threshold", "peak_to_threshold_ratio", "duration_s", "source"))


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("audio"))


def spectrum_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.spectral_features(_arrays(spark, sf_dir).withColumn("sample_rate_hz", F.lit(RATE_HZ)))
    return rounded(found.drop("sample_rate_hz"), 6, {"spectral_centroid_hz": 3, "spectral_bandwidth_hz": 3})


def window_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of the runs' own windows, whose lengths differ, as if sampled at RATE_HZ."""
    cut = _windows(spark, sf_dir).select("run_name", "episode_ix", "window_ix", "start_index", "end_index")
    arrays = features.window_arrays(_signals(spark, sf_dir), cut).drop("start_index", "end_index")
    found = features.spectral_features(arrays.withColumn("sample_rate_hz", F.lit(RATE_HZ)))
    return rounded(found.drop("sample_rate_hz"), 6, {"spectral_centroid_hz": 3, "spectral_bandwidth_hz": 3})


def frame_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = _arrays(spark, sf_dir).select("vec_id", F.posexplode(spectrograms.frames_column(spectrograms.padded_column(F.col("audio"), 16), 16, 10)).alias("frame_ix", "frame"))
    total = F.aggregate("frame", F.lit(0.0), lambda a, x: a + x)
    return rounded(framed.select("vec_id", "frame_ix", F.size("frame").alias("n"), total.alias("total")))


def log_spectrogram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spectrograms.with_spectrogram(_arrays(spark, sf_dir), SpectrogramConfig(16, 8, 1e-8, False))
    flat = F.flatten("spectrogram")
    found = made.select("vec_id", F.size("spectrogram").alias("n_bins"), F.size(F.element_at("spectrogram", 1)).alias("n_frames"), (F.aggregate(flat, F.lit(0.0), lambda a, x: a + x) / F.size(flat)).alias("mean_power"), F.array_max(flat).alias("max_power"))
    return rounded(found, 5)


def spectrogram_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, greatest and mean square of each array's standardised spectrogram."""
    made = spectrograms.with_spectrogram(_arrays(spark, sf_dir), SpectrogramConfig(16, 8, 1e-8, True))
    flat = F.flatten("spectrogram")
    return rounded(made.select("vec_id", F.array_min(flat).alias("least"), F.array_max(flat).alias("most"), (F.aggregate(flat, F.lit(0.0), lambda a, x: a + x * x) / F.size(flat)).alias("mean_square")), 5)


def synthetic_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generator, features, labels, grouped cross-validation and sweep end to end, on a few short runs."""
    from millrace.plans.pipelines import synthetic_evaluation as run
    from millrace.sources.synthetic import run_configs

    return run(spark, run_configs(4, duration_s=40.0, sample_rate_hz=200.0, event_rate_per_minute=6.0))
