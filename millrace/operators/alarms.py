"""From scores to alarms, from alarms to matches and metrics, for one threshold or many at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.events import number
from millrace.operators.greedy import match_latest, thin
from millrace.schema import require

#: Default thresholds of a sweep.
SWEEP = (0.05, 0.10, 0.15, 0.20, 0.30, 0.50)


@dataclass(frozen=True)
class EvaluationConfig:
    max_early_s: float = 2.0
    refractory_s: float = 1.0
    consensus_k: int = 1
    consensus_n: int = 1


def parse_thresholds(text: str) -> tuple[float, ...]:
    """Comma-separated numbers between 0 and 1."""
    found = tuple(float(part.strip()) for part in text.split(","))
    if any(not 0 <= t <= 1 for t in found):
        raise ValueError("thresholds must lie between 0 and 1.")
    return found


def optional_seconds(x: Column) -> Column:
    """Seconds as text; format_string would spell null out."""
    return F.when(x.isNull(), F.lit("n/a")).otherwise(F.format_string("%.3fs", x))


def checked_consensus(k: int, n: int) -> None:
    if k <= 0 or n <= 0:
        raise ValueError("A consensus is of one window or more, out of one or more.")
    if k > n:
        raise ValueError("A consensus of k out of n needs k windows among the n.")


def with_thresholds(predictions: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """A copy of every row for each threshold, by an explode of a literal array."""
    if any(not 0 <= t <= 1 for t in thresholds):
        raise ValueError("thresholds must lie between 0 and 1.")
    return predictions.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def consensus(rows: DataFrame, k: int = 1, n: int = 1, score: str = "score", keys: tuple[str, ...] = ("threshold", "run_name")) -> DataFrame:
    """Rows at which k of the run's latest n scores reach the threshold; the row's own may be below it."""
    checked_consensus(k, n)
    require(rows, {"run_name", "detection_time", score}, "columns")
    ties = [c for c in ("episode_ix", "window_ix") if c in rows.columns]
    latest = Window.partitionBy(*keys).orderBy("detection_time", *ties).rowsBetween(-(n - 1), 0)
    hit = F.coalesce((number(F.col(score).cast("double")) >= F.col("threshold")).cast("int"), F.lit(0))
    return rows.withColumn("hits", F.sum(hit).over(latest)).where(F.col("hits") >= k).drop("hits")


def detections(predictions: DataFrame, thresholds: tuple[float, ...] = (0.5,), k: int = 1, n: int = 1, score: str = "score") -> DataFrame:
    """threshold, run_name, detection_time, score of every alarm before suppression."""
    return consensus(with_thresholds(predictions, thresholds), k, n, score).select("threshold", "run_name", "detection_time", F.col(score).alias("score"))


def suppress(found: DataFrame, refractory_s: float = 1.0) -> DataFrame:
    """Alarms that come more than refractory_s after the last one kept, per threshold and run."""
    if refractory_s < 0:
        raise ValueError("The refractory time has to be 0 seconds or more.")
    return thin(found, ["threshold", "run_name"], "detection_time", refractory_s, strict=True, ties=("score",))


def match(events: DataFrame, found: DataFrame, thresholds: tuple[float, ...], max_early_s: float = 2.0) -> DataFrame:
    """Every event and alarm of every threshold with what it matched (see match_latest)."""
    require(events, {"run_name", "peak_time"}, "event columns")
    if max_early_s <= 0:
        raise ValueError("Alarms have to be allowed to come early by more than 0 seconds.")
    wanted = with_thresholds(events.select("run_name", F.col("peak_time").alias("time_s")), thresholds).withColumn("is_event", F.lit(True))
    alarms = found.select("run_name", F.col("detection_time").alias("time_s"), "threshold").withColumn("is_event", F.lit(False))
    return match_latest(wanted.unionByName(alarms), ["threshold", "run_name"], max_early_s)


def event_matches(matched: DataFrame) -> DataFrame:
    """threshold, run_name, event_peak_time, detection_time, advance_time_s; the last two null where missed."""
    return matched.where("is_event").select("threshold", "run_name", F.col("time_s").alias("event_peak_time"), F.col("matched_time").alias("detection_time"), (F.col("time_s") - F.col("matched_time")).alias("advance_time_s"))


def false_detections(matched: DataFrame) -> DataFrame:
    return matched.where(~F.col("is_event") & ~F.col("matched")).select("threshold", "run_name", F.col("time_s").alias("detection_time"))


def _counts() -> list[Column]:
    """What adds up over runs: events, events met, false alarms, and the seconds of advance."""
    event, hit = F.col("is_event"), F.col("is_event") & F.col("matched")
    return [F.count_if(event).alias("events"), F.count_if(hit).alias("hits"), F.count_if(~event & ~F.col("matched")).alias("false"), F.sum(F.when(hit, F.col("time_s") - F.col("matched_time"))).alias("advance")]


def _metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Rates from summed counts and seconds; a total of no seconds raises."""
    refuse = F.raise_error(F.lit("no evaluated seconds")).cast("double")
    rows = rows.withColumn("seconds", F.when(F.col("seconds") > 0, F.col("seconds")).otherwise(refuse)).na.fill(0, ["events", "hits", "false"])
    return rows.select(
        *keys,
        F.col("events").alias("n_reference_events"),
        F.col("hits").alias("n_detected_events"),
        F.col("false").alias("n_false_detections"),
        F.when(F.col("events") > 0, F.col("hits") / F.when(F.col("events") > 0, F.col("events"))).otherwise(F.lit(0.0)).alias("true_positive_rate"),
        (F.col("false") / (F.col("seconds") / 3600.0)).alias("false_detections_per_hour"),
        F.try_divide(F.col("seconds"), F.col("false")).alias("mean_seconds_between_false_detections"),
        F.try_divide(F.col("advance"), F.col("hits")).alias("average_advance_time_s"),
    )


def summarize(matched: DataFrame, durations: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """One row of metrics per threshold; runs without windows or alarms count with their time and events.

    durations has run_name and evaluated_duration_s. A total of no seconds raises.
    """
    seconds = durations.agg(F.coalesce(F.sum("evaluated_duration_s"), F.lit(0.0)).alias("seconds"))
    asked = with_thresholds(seconds, thresholds)  # one row a threshold
    return _metrics(asked.join(matched.groupBy("threshold").agg(*_counts()), "threshold", "left"), "threshold")


def summarize_folds(matched: DataFrame, durations: DataFrame, folds: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Metrics per threshold and fold, and per threshold over all folds (null fold), in one rollup.

    folds has run_name and fold. Alarms and matches never leave their run and a run is in
    one fold, so counts and seconds per run add up to either level.
    """
    runs = with_thresholds(durations.join(folds.select("run_name", "fold"), "run_name"), thresholds)
    per_run = matched.groupBy("threshold", "run_name").agg(*_counts())
    levels = runs.join(per_run, ["threshold", "run_name"], "left").rollup("threshold", "fold")
    summed = levels.agg(F.sum("evaluated_duration_s").alias("seconds"), *[F.sum(c).alias(c) for c in ("events", "hits", "false", "advance")])
    return _metrics(summed.where("threshold is not null"), "threshold", "fold")


def evaluate(predictions: DataFrame, events: DataFrame, durations: DataFrame, thresholds: tuple[float, ...] = (0.5,), config: EvaluationConfig = EvaluationConfig(), score: str = "score") -> DataFrame:  # noqa: B008
    """Consensus, suppression, matching and metrics for all thresholds in one plan."""
    alarms = suppress(detections(predictions, thresholds, config.consensus_k, config.consensus_n, score), config.refractory_s)
    return summarize(match(events, alarms, thresholds, config.max_early_s), durations, thresholds)
