"""Command line: `python -m millrace COMMAND ...`, a command for each end-to-end query."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import alarms, events, forest
from millrace.operators.episodes import episodes, whole_runs
from millrace.plans import pipelines
from millrace.sources import files, sinks, synthetic


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    commands = top.add_subparsers(dest="command", required=True)

    def evaluation(name: str, max_early_s: float) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("directory")
        for option, default in (("window-s", 0.5), ("hop-s", 0.1), ("positive-horizon-s", 1.0), ("post-event-exclusion-s", 1.0), ("max-early-s", max_early_s), ("refractory-s", 1.0)):
            p.add_argument(f"--{option}", type=float, default=default)
        for option, default in (("consensus-k", 1), ("consensus-n", 1), ("n-splits", 5), ("trees", 100), ("leaf", 1), ("seed", 42)):
            p.add_argument(f"--{option}", type=int, default=default)
        p.add_argument("--depth", type=int, default=None)
        p.add_argument("--score-threshold", type=float, default=0.1)
        p.add_argument("--threshold-sweep", type=alarms.parse_thresholds, default=alarms.SWEEP)
        return p

    measured = evaluation("evaluate-measured", 2.0)
    measured.add_argument("--raster", type=float, default=0.001)
    measured.add_argument("--window-region", choices=("header-on", "extended"), default="header-on")
    measured.add_argument("--event-threshold-quantile", type=float, default=0.999)
    measured.add_argument("--min-ratio", type=float, default=1.0)
    evaluation("evaluate-directory", 1.0).add_argument("--max-runs", type=int, default=None)

    export = commands.add_parser("export")
    export.add_argument("directory")
    export.add_argument("output")
    export.add_argument("--max-runs", type=int, default=100)
    export.add_argument("--trees", type=int, default=8)
    export.add_argument("--depth", type=int, default=6)
    export.add_argument("--leaf", type=int, default=4)
    export.add_argument("--seed", type=int, default=42)
    for option, default in (("window-s", 0.5), ("hop-s", 0.1), ("positive-horizon-s", 1.0), ("post-event-exclusion-s", 1.0)):
        export.add_argument(f"--{option}", type=float, default=default)

    audit = commands.add_parser("audit")
    audit.add_argument("directory")
    audit.add_argument("--raster", type=float, default=0.001)
    audit.add_argument("--event-threshold-quantile", type=float, default=0.999)
    audit.add_argument("--min-ratio", type=float, default=1.0)

    inspect = commands.add_parser("inspect-events")
    inspect.add_argument("directory")
    inspect.add_argument("--raster", type=float, default=0.001)
    inspect.add_argument("--quantile", type=float, default=0.995)
    inspect.add_argument("--min-gap-s", type=float, default=0.5)
    inspect.add_argument("--lookback-s", type=float, default=2.0)

    profile = commands.add_parser("inspect-data")
    profile.add_argument("directory")
    profile.add_argument("--raster", type=float, default=None)

    generate = commands.add_parser("generate")
    generate.add_argument("directory")
    generate.add_argument("--n-runs", type=int, default=100)
    generate.add_argument("--duration-s", type=float, default=120.0)
    generate.add_argument("--sample-rate-hz", type=float, default=1000.0)
    generate.add_argument("--base-seed", type=int, default=42)
    generate.add_argument("--event-rate-per-minute", type=float, default=2.0)
    return top


def _config(args: argparse.Namespace) -> pipelines.PipelineConfig:
    return pipelines.PipelineConfig(
        window_s=args.window_s,
        hop_s=args.hop_s,
        positive_horizon_s=args.positive_horizon_s,
        post_event_exclusion_s=args.post_event_exclusion_s,
        thresholds=tuple(sorted({*args.threshold_sweep, args.score_threshold})),
        evaluation=alarms.EvaluationConfig(args.max_early_s, args.refractory_s, args.consensus_k, args.consensus_n),
        forest=forest.ForestConfig(n_estimators=args.trees, max_depth=args.depth, min_samples_leaf=args.leaf, random_state=args.seed, n_splits=args.n_splits),
    )


def _inspected(signals: DataFrame, args: argparse.Namespace) -> DataFrame:
    found = events.detect_events(signals, whole_runs(signals), args.quantile, args.min_gap_s, 0.0, deduplicate=False)
    seen = events.with_recent_header(signals, args.lookback_s).select(F.col("run_name").alias("of_run"), F.col("time_s").alias("at"), "HeaderOn", "recently_on")
    return found.join(seen, (F.col("run_name") == F.col("of_run")) & (F.col("peak_time") == F.col("at"))).select("run_name", "start_time", "peak_time", "end_time", "peak_voltage", "threshold", "HeaderOn", "recently_on")


def _labels(counts: DataFrame) -> None:
    """Windows and labels per run, and of all runs, ahead of an evaluation."""
    sums = [F.sum(c).alias(c) for c in counts.columns if c != "run_name"]
    counts.orderBy("run_name").show(1000, False)
    counts.agg(F.count(F.lit(1)).alias("n_runs"), *sums).show()


def _metrics(found: DataFrame, args: argparse.Namespace) -> None:
    """The asked threshold by fold and overall, then all thresholds overall."""
    found.where(F.col("threshold") == args.score_threshold).orderBy("fold").show(1000, False)
    found.where("fold is null").drop("fold").orderBy("threshold").show(1000, False)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("millrace").getOrCreate()
    if args.command == "evaluate-measured":
        config = replace(_config(args), region=args.window_region, event_quantile=args.event_threshold_quantile, min_ratio=args.min_ratio)
        _metrics(pipelines.measured_evaluation(spark, args.directory, args.raster, config, _labels), args)
    elif args.command == "evaluate-directory":
        _metrics(pipelines.directory_evaluation(spark, args.directory, args.max_runs, _config(args), _labels), args)
    elif args.command == "export":
        signals = files.read_runs(spark, args.directory, args.max_runs)
        truth = events.with_ratio(events.metadata_to_events(files.read_metadata(spark, args.directory))).join(signals.select("run_name").distinct(), "run_name", "left_semi")
        config = replace(pipelines.SYNTHETIC, window_s=args.window_s, hop_s=args.hop_s, positive_horizon_s=args.positive_horizon_s, post_event_exclusion_s=args.post_event_exclusion_s)
        labeled, _ = pipelines.labeled_features(signals, truth, config)
        compact = replace(pipelines.COMPACT, n_estimators=args.trees, max_depth=args.depth, min_samples_leaf=args.leaf, random_state=args.seed)
        labeled = labeled.persist()
        pipelines.export_forest(spark, labeled, args.output, config=compact)
        labeled.unpersist()
    elif args.command == "audit":
        signals = files.read_measurements(spark, args.directory, args.raster)
        audited = events.audit(events.detect_events(signals, episodes(signals), args.event_threshold_quantile)).persist()
        events.audit_summary(audited, args.min_ratio).orderBy("run_name").show(1000, False)
        events.weakest(audited).show(10, False)
        audited.unpersist()
    elif args.command == "inspect-events":
        _inspected(files.read_measurements(spark, args.directory, args.raster), args).orderBy("run_name", "peak_time").show(1000, False)
    elif args.command == "inspect-data":
        signals = files.read_measurements(spark, args.directory, args.raster)
        signals.groupBy("run_name").agg(F.count(F.lit(1)).alias("n_rows"), F.min("time_s").alias("start_time"), F.max("time_s").alias("end_time"), F.count_if("HeaderOn").alias("n_on")).orderBy("run_name").show(1000, False)
    else:
        configs = synthetic.run_configs(args.n_runs, args.base_seed, args.duration_s, args.sample_rate_hz, args.event_rate_per_minute)
        signals, metadata = synthetic.generate_dataset(spark, configs)
        sinks.write_run_files(signals, args.directory)
        sinks.write_metadata_file(metadata, args.directory)
