"""End-to-end pipelines: measured runs, synthetic runs, and the export of a compact forest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import alarms, events, features, forest, labels, windows
from millrace.operators.episodes import episodes, evaluated_durations
from millrace.sources import sinks, synthetic
from millrace.sources.files import read_measurements, read_metadata, read_runs


@dataclass(frozen=True)
class PipelineConfig:
    window_s: float = 0.5
    hop_s: float = 0.1
    positive_horizon_s: float = 1.0
    post_event_exclusion_s: float = 1.0
    region: str = "header-on"
    event_quantile: float = 0.999
    min_ratio: float = 1.0
    thresholds: tuple[float, ...] = alarms.SWEEP
    evaluation: alarms.EvaluationConfig = alarms.EvaluationConfig()
    forest: forest.ForestConfig = forest.ForestConfig()


def labeled_features(signals: DataFrame, found: DataFrame, config: PipelineConfig) -> tuple[DataFrame, DataFrame]:
    """The labelled feature table with deltas, and the evaluated seconds of every run."""
    eps = episodes(signals)
    cut = windows.sliding_windows(signals, eps, config.window_s, config.hop_s, config.region)
    table = features.temporal_deltas(features.feature_table(signals, cut))
    labeled = labels.label_features(table, found, config.positive_horizon_s, config.post_event_exclusion_s)
    return labeled, evaluated_durations(eps, config.region)


#: What is shown of the labelled windows before they are evaluated, if anything.
Report = Callable[[DataFrame], None] | None


def evaluation(signals: DataFrame, found: DataFrame, config: PipelineConfig, report: Report = None) -> DataFrame:
    """Metrics per threshold and fold, and overall (null fold), of forests that never saw a run they score.

    report gets the label counts per run first. The result is a table of its own, a row for
    each threshold and fold: the runs, events and features that it was made from are let go.
    """
    signals, found = signals.persist(), found.persist()
    labeled, seconds = labeled_features(signals, found, config)
    labeled = labeled.persist()  # every fold reads it
    try:
        if labeled.isEmpty():
            raise RuntimeError("No windows: check the episodes and the window length.")
        if report is not None:
            report(labels.label_counts(labeled))
        folds = forest.group_folds(labeled, config.forest.n_splits)
        scored = forest.cross_validate(labeled, config.forest, folds)
        e = config.evaluation
        kept = alarms.suppress(alarms.detections(scored, config.thresholds, e.consensus_k, e.consensus_n), e.refractory_s)
        # Runs without windows have no fold; they still count towards the overall rows.
        every = seconds.select("run_name").join(folds, "run_name", "left").select("run_name", F.coalesce("fold", F.lit(-1)).alias("fold"))
        summary = alarms.summarize_folds(alarms.match(found, kept, config.thresholds, e.max_early_s), seconds, every, config.thresholds)
        return signals.sparkSession.createDataFrame(summary.collect(), summary.schema)  # thresholds by folds
    finally:
        for table in (labeled, found, signals):
            table.unpersist()


def measured_evaluation(spark: SparkSession, directory: str, raster: float = 0.001, config: PipelineConfig = PipelineConfig(), report: Report = None) -> DataFrame:  # noqa: B008
    """Measurement files: events from the voltage channel, then evaluation."""
    signals = read_measurements(spark, directory, raster)
    found = events.filter_by_ratio(events.detect_events(signals, episodes(signals), config.event_quantile), config.min_ratio)
    return evaluation(signals, found, config, report)


SYNTHETIC = PipelineConfig(evaluation=alarms.EvaluationConfig(max_early_s=1.0))


def directory_evaluation(spark: SparkSession, directory: str, max_runs: int | None = None, config: PipelineConfig = SYNTHETIC, report: Report = None) -> DataFrame:
    """Generated CSV runs with their metadata as events."""
    signals = read_runs(spark, directory, max_runs)
    metadata = read_metadata(spark, directory).join(signals.select("run_name").distinct(), "run_name", "left_semi")
    return evaluation(signals, events.with_ratio(events.metadata_to_events(metadata)), config, report)


def synthetic_evaluation(spark: SparkSession, configs: list[synthetic.RunConfig], config: PipelineConfig | None = None) -> DataFrame:
    """Runs straight from the generator."""
    config = config or PipelineConfig(evaluation=alarms.EvaluationConfig(max_early_s=1.0), forest=forest.ForestConfig(n_estimators=10, max_depth=6, n_splits=2))
    signals, metadata = synthetic.generate_dataset(spark, configs)
    return evaluation(signals, events.with_ratio(events.metadata_to_events(metadata)), config)


COMPACT = forest.ForestConfig(n_estimators=8, max_depth=6, min_samples_leaf=4)


def export_forest(spark: SparkSession, labeled: DataFrame, path: str, name: str = "early_warning_forest", config: forest.ForestConfig = COMPACT) -> DataFrame:
    """Trains one compact forest on all rows and writes its JSON, C header, feature list and note; returns its nodes."""
    model = forest.train(labeled, config)
    nodes = forest.nodes(model, f"{path}/model")  # read from the saved model, a row a node
    names, size = forest.feature_names(model), forest.size_bytes(nodes).first()
    trees = forest.tree_arrays(nodes)
    sinks.write_text(spark, f"{path}/{name}.json", sinks.forest_json(trees, names, name, size["model_bytes"]))
    sinks.write_text(spark, f"{path}/{name}.h", sinks.forest_header(trees, names, name, size["model_bytes"]))
    sinks.write_text(spark, f"{path}/feature_order.txt", sinks.feature_list(names))
    sinks.write_text(spark, f"{path}/README.md", sinks.deployment_note(name, size["n_trees"], len(names), size["model_bytes"]))
    return nodes.select("tree_id", "node_id", "left_child", "right_child", "feature", F.col("threshold").cast("float").alias("threshold"), F.col("value").cast("float").alias("value"))
