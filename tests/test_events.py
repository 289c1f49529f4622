import math

import numpy as np
import pytest
from helpers import run_of
from pyspark.sql import functions as F

from millrace.operators import events, labels, ranges, windows
from millrace.operators.episodes import episodes
from millrace.schema import EVENTS


def one_episode(spark, start, end, run="r"):
    return spark.createDataFrame([(run, 0, float(start), float(end), float(end))], "run_name string, episode_ix int, start_time double, end_time double, extended_end_time double")


def detect(spark, volts, span, **options):
    return events.detect_events(run_of(spark, voltage=volts), one_episode(spark, *span), **options).orderBy("start_time").collect()


def test_gap_groups(spark):
    times = [0.25, 0.5, 1.0, 1.75, 4.0, 4.75, 9.5]
    df = spark.createDataFrame([("r", t) for t in times], "run_name string, time_s double")
    groups = events.gap_groups(df, ["run_name"], 0.75).groupBy("group_ix").agg(F.min("time_s").alias("a"), F.max("time_s").alias("b")).orderBy("group_ix")
    assert [(r["a"], r["b"]) for r in groups.collect()] == [(0.25, 1.75), (4.0, 4.75), (9.5, 9.5)]
    with pytest.raises(ValueError):
        events.gap_groups(df, ["run_name"], -1)


def test_detection(spark):
    volts = [3, 4, 2, 31, 47, 38, 5, 3, 33, 2]
    assert list(np.flatnonzero(np.array(volts) > np.quantile(volts, 0.6))) == [3, 4, 5, 8]  # a gap parts sample 8 from the others
    a, b = detect(spark, volts, (0, 9), threshold_quantile=0.6, min_gap_s=1.5, min_duration_s=0)
    assert (a["start_time"], a["peak_time"], a["end_time"], a["peak_voltage"], a["source"]) == (3, 4, 5, 47, "VoltageSignal")
    assert (b["start_time"], b["peak_time"], b["end_time"]) == (8, 8, 8) and b["threshold"] == pytest.approx(np.quantile(volts, 0.6))
    # Samples outside the episode count for nothing; an event that is too short goes.
    (e,) = detect(spark, [7, 900, 7, 7, 14, 18, 16, 9], (3, 7), threshold_quantile=0.5, min_gap_s=1.5, min_duration_s=0)
    assert (e["peak_time"], e["peak_voltage"], e["threshold"]) == (5, 18, np.quantile([7, 14, 18, 16, 9], 0.5))
    assert detect(spark, [6, 6, 70, 6, 6, 6], (0, 5), threshold_quantile=0.8, min_gap_s=0.5, min_duration_s=0.5) == []
    (e,) = detect(spark, [0, 0, 8, 9, 0, 0], (0, 5), threshold_quantile=0.25, min_gap_s=1.5, min_duration_s=0)
    assert e["threshold"] == 0 and math.isinf(e["peak_to_threshold_ratio"])
    # The first of equal peaks counts; what is not a number passes no threshold.
    (e,) = detect(spark, [1, 9, 9, 9, 1, 1, 1, float("nan")], (0, 7), threshold_quantile=0.5, min_gap_s=1.1, min_duration_s=0)
    assert (e["peak_time"], e["end_time"]) == (1, 3)


def test_dedup_prefers_the_nearest_episode_end_in_a_bucket(spark):
    # Two in the bucket of 6.25 s, the nearer to its episode's end weaker; one in the next bucket.
    rows = [("r", 6.0, 6.25, 7.0, 64.0, 8.0, 0.0, 30.0, "a"), ("r", 6.0, 6.2503, 7.0, 24.0, 8.0, 0.0, 6.5, "b"), ("r", 6.0, 6.2508, 7.0, 24.0, 8.0, 0.0, 6.5, "edge")]
    df = spark.createDataFrame(rows, EVENTS).withColumn("episode_ix", F.lit(0))
    assert sorted(r["source"] for r in events.dedup_events(df).collect()) == ["b", "edge"]
    with pytest.raises(ValueError):
        events.dedup_events(df, 0)


def test_long_runs_meet_their_episodes_chunk_by_chunk(spark, monkeypatch):
    """However time is cut, episodes, windows and labels are the same."""
    r = np.random.default_rng(1)
    volts, header = r.integers(0, 50, 300).tolist(), [bool(i // 40 % 2) for i in range(300)]
    signals = run_of(spark, voltage=volts, header=header, audio=volts).unionByName(run_of(spark, run="s", voltage=volts[:5], header=header[:5], audio=volts[:5]))

    def results() -> list:
        eps = episodes(signals, grace_s=7.0)
        found = events.detect_events(signals, eps, 0.8, 2.0, 0.0)
        cut, timed = (f(signals, eps, 6.0, 3.0, "extended") for f in (windows.sliding_windows, windows.timed_windows))
        return [sorted(map(tuple, t.collect())) for t in (found, cut, timed, labels.label_windows(cut, found, 5.0, 2.0))]

    whole = results()
    assert all(len(t) > 5 for t in whole)
    monkeypatch.setattr(ranges, "CHUNK_ROWS", 7)
    assert results() == whole


def test_ratio_audit_and_weakest(spark):
    rows = [("r", 1.0, 2.0, 3.0, 10.0, 5.0, 0.0, 2.5, "x"), ("r", 4.0, 5.0, 6.0, 10.0, 10.0, 0.0, 4.5, "y")]
    df = events.with_ratio(spark.createDataFrame(rows, EVENTS))
    assert [r["source"] for r in events.filter_by_ratio(df, 1.5).collect()] == ["x"]
    with pytest.raises(ValueError):
        events.filter_by_ratio(df, -0.1)
    audited = events.audit(df)
    assert [(r["event_index"], r["time_from_episode_end_to_peak"], r["inside_header_on_episode"]) for r in audited.orderBy("event_index").collect()] == [(1, -0.5, True), (2, 0.5, False)]
    total = events.audit_summary(audited, 1.5).where("run_name is null").first()
    assert (total["n_events"], total["n_strong"], total["n_inside"], total["median_ratio"]) == (2, 1, 1, 1.5)
    assert [r["source"] for r in events.weakest(audited, 1).collect()] == ["y"]


def test_recent_header_is_closed_on_both_sides(spark):
    df = events.with_recent_header(run_of(spark, header=[True, False, False, False]), 2.0)
    assert [r["recently_on"] for r in df.orderBy("pos").collect()] == [True, True, True, False]


def test_metadata(spark):
    df = spark.createDataFrame([("r", 3.5, 2.25)], "run_name string, event_time double, amplitude double")
    row = events.with_ratio(events.metadata_to_events(df)).first()
    assert (row["peak_time"], row["threshold"], row["peak_to_threshold_ratio"], row["duration_s"]) == (3.5, 1.0, 2.25, 0.0)
    with pytest.raises(ValueError, match="amplitude"):
        events.metadata_to_events(df.drop("amplitude"))
