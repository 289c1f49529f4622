import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.operators import alarms, greedy, labels


def label(spark, end, peaks, run="r"):
    w = spark.createDataFrame([("r", end - 1, end, end)], "run_name string, window_start double, window_end double, detection_time double")
    e = spark.createDataFrame([(run, float(p)) for p in peaks], "run_name string, peak_time double")
    r = labels.label_features(w, e, 2.0, 1.0).first()
    return r["label"], r["time_to_event_s"]


@pytest.mark.parametrize(
    ("end", "peaks", "expected"), [(9.0, [10], (1, 1.0)), (6.0, [10], (0, None)), (10.5, [10], (-1, -0.5)), (10.7, [10, 11.5], (-1, -0.7)), (10.0, [10], (-1, 0.0)), (8.0, [10], (1, 2.0)), (9.5, [], (0, None))]
)
def test_labels(spark, end, peaks, expected):
    found = label(spark, end, peaks)
    assert found[0] == expected[0] and found[1] == (pytest.approx(expected[1]) if expected[1] is not None else None)


def test_labels_keep_runs_apart_and_refuse_odd_windows(spark):
    assert label(spark, 9.5, [10], run="other") == (0, None)
    w = spark.createDataFrame([("r", 0.0, 1.0, 1.5)], "run_name string, window_start double, window_end double, detection_time double")
    e = spark.createDataFrame([], "run_name string, peak_time double")
    with pytest.raises(PySparkException, match="another time"):
        labels.label_features(w, e).collect()
    with pytest.raises(ValueError):
        labels.label_windows(w, e, 0)
    with pytest.raises(ValueError):
        labels.label_windows(w, e, 1, -1)


def scores(spark, rows):
    return spark.createDataFrame([(r, float(t), s) for r, t, s in rows], "run_name string, detection_time double, score double")


def found_alarms(df):
    return [(r["run_name"], r["detection_time"]) for r in df.orderBy("run_name", "detection_time").collect()]


def test_thresholds_and_consensus(spark):
    one = scores(spark, [("r", 8, 0.2), ("r", 9.2, 0.8), ("r", 12, 0.9), ("r", 13, float("nan")), ("r", 14, None)])
    assert found_alarms(alarms.detections(one)) == [("r", 9.2), ("r", 12.0)]
    four = scores(spark, [("r", 1, 0.6), ("r", 2, 0.2), ("r", 3, 0.7), ("r", 4, 0.8)])
    assert found_alarms(alarms.detections(four, (0.5,), 2, 3)) == [("r", 3.0), ("r", 4.0)]
    # An alarm may fall on a row that is itself below the threshold.
    assert found_alarms(alarms.detections(scores(spark, [("r", 1, 0.8), ("r", 2, 0.8), ("r", 3, 0.2)]), (0.5,), 2, 3)) == [("r", 2.0), ("r", 3.0)]
    assert found_alarms(alarms.detections(scores(spark, [("a", 1, 0.9), ("b", 2, 0.9)]), (0.5,), 2, 2)) == []
    for k, n in ((0, 1), (1, 0), (3, 2)):
        with pytest.raises(ValueError):
            alarms.detections(one, (0.5,), k, n)
    with pytest.raises(ValueError):
        alarms.detections(one, (1.5,))


def test_suppression_and_spacing(spark):
    def kept(times, seconds=1.0, strict=True):
        df = spark.createDataFrame([("r", float(t)) for t in times], "run_name string, t double")
        return [r["t"] for r in greedy.thin(df, ["run_name"], "t", seconds, strict).orderBy("t").collect()]

    assert kept([1, 1.5, 3]) == [1, 3] and kept([1, 2, 2.5]) == [1, 2.5]
    assert kept([1, 2, 4.5, 8], 3.0, False) == [1, 4.5, 8]
    with pytest.raises(ValueError):
        kept([1], -1)


def match(spark, peaks, times, early=2.0):
    e = spark.createDataFrame([("r", float(p)) for p in peaks], "run_name string, peak_time double")
    d = scores(spark, [("r", t, 1.0) for t in times]).withColumn("threshold", F.lit(0.5))
    both = alarms.match(e, d, (0.5,), early)
    return {r["event_peak_time"]: r["detection_time"] for r in alarms.event_matches(both).collect()}, sorted(r["detection_time"] for r in alarms.false_detections(both).collect())


@pytest.mark.parametrize(
    ("peaks", "times", "matches", "false"),
    [
        ([10], [9.2, 12], {10: 9.2}, [12]),
        ([10], [8.5, 9.4, 9.8], {10: 9.8}, [8.5, 9.4]),
        ([10], [6], {10: None}, [6]),
        ([10], [8.0], {10: None}, [8.0]),
        ([10], [10.0], {10: None}, [10.0]),
        ([10, 10.5], [8.5, 9.4, 9.8], {10: 9.8, 10.5: 9.4}, [8.5]),
        ([10], [], {10: None}, []),
        ([], [1], {}, [1]),
    ],
)
def test_matches(spark, peaks, times, matches, false):
    assert match(spark, peaks, times) == (matches, false)


def test_matches_against_the_definition(spark):
    r = random.Random(6)
    for _ in range(6):
        peaks, times = sorted(r.sample(range(200), 25)), sorted(r.sample(range(200), 60))
        free, expected = set(times), {}
        for p in peaks:
            near = [t for t in free if p - 9 < t < p]
            expected[p] = max(near, default=None)
            free.discard(expected[p])
        assert match(spark, peaks, times, 9.0) == (expected, sorted(free))


def test_evaluation_and_sweep(spark):
    e = spark.createDataFrame([("r", 10.0)], "run_name string, peak_time double")
    seconds = spark.createDataFrame([("r", 1800.0), ("silent", 1800.0)], "run_name string, evaluated_duration_s double")
    p = scores(spark, [("r", 8, 0.9), ("r", 9.2, 0.8), ("r", 12, 0.6)])
    config = alarms.EvaluationConfig(refractory_s=0.5)
    rows = {r["threshold"]: r for r in alarms.evaluate(p, e, seconds, (0.5, 0.7, 0.95), config).collect()}
    assert (rows[0.5]["n_detected_events"], rows[0.5]["n_false_detections"], rows[0.5]["false_detections_per_hour"]) == (1, 2, 2.0)
    assert rows[0.7]["average_advance_time_s"] == pytest.approx(0.8) and rows[0.7]["mean_seconds_between_false_detections"] == 3600
    assert (rows[0.95]["true_positive_rate"], rows[0.95]["mean_seconds_between_false_detections"], rows[0.95]["average_advance_time_s"]) == (0, None, None)
    with pytest.raises(PySparkException, match="no evaluated seconds"):
        alarms.evaluate(p, e, seconds.limit(0), (0.5,)).collect()
    assert alarms.parse_thresholds("0.05, 0.10,0.50") == (0.05, 0.1, 0.5)
    for bad in ("", "2", "x"):
        with pytest.raises(ValueError):
            alarms.parse_thresholds(bad)


def test_fold_and_overall_metrics_come_from_one_rollup(spark):
    e = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("b", 40.0)], "run_name string, peak_time double")
    seconds = spark.createDataFrame([("a", 100.0), ("b", 200.0), ("c", 300.0)], "run_name string, evaluated_duration_s double")
    folds = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "run_name string, fold int")
    p = scores(spark, [("a", 9.5, 0.9), ("b", 19.0, 0.9), ("b", 30.0, 0.6)])
    found = alarms.suppress(alarms.detections(p, (0.5, 0.8)), 1.0)
    matched = alarms.match(e, found, (0.5, 0.8), 2.0)
    rows = {(r["threshold"], r["fold"]): r for r in alarms.summarize_folds(matched, seconds, folds, (0.5, 0.8)).collect()}
    assert len(rows) == 6
    overall = {r["threshold"]: r for r in alarms.summarize(matched, seconds, (0.5, 0.8)).collect()}
    for t in (0.5, 0.8):
        assert [rows[t, None][c] for c in overall[t].asDict()] == [pytest.approx(v) for v in overall[t]]
    assert (rows[0.5, 1]["n_reference_events"], rows[0.5, 1]["n_detected_events"], rows[0.5, 1]["n_false_detections"]) == (2, 1, 1)
    assert rows[0.8, 0]["true_positive_rate"] == 1.0 and rows[0.8, 1]["mean_seconds_between_false_detections"] is None


def test_rows_without_a_time_come_to_nothing(spark):
    df = spark.createDataFrame([("r", None), ("r", 1.0), ("r", 1.5), ("r", None), ("r", 3.0), ("s", None)], "run_name string, time_s double")
    assert sorted(r["time_s"] for r in greedy.thin(df, ["run_name"], "time_s", 1.0, strict=False).collect()) == [1.0, 3.0]
    rows = [("r", None, True), ("r", None, False), ("r", 1.0, False), ("r", 2.0, True), ("s", None, True)]
    found = greedy.match_latest(spark.createDataFrame(rows, "run_name string, time_s double, is_event boolean"), ["run_name"], 5.0).collect()
    assert sorted((str(r["time_s"]), r["is_event"], r["matched"], r["matched_time"]) for r in found) == [("1.0", False, True, 2.0), ("2.0", True, True, 1.0), ("None", False, False, None), ("None", True, False, None), ("None", True, False, None)]


def test_matching_by_definition_and_with_few_waiting(spark):
    """Against the definition, event by event; alarms of a long run without events leave batch by batch."""
    r = random.Random(3)
    rows = sorted({(f"run{r.randrange(3)}", r.randrange(60) / 2, r.random() < 0.3) for _ in range(120)})
    df = spark.createDataFrame(rows, "run_name string, time_s double, is_event boolean")
    want = []
    for run in sorted({x[0] for x in rows}):
        free = [t for n, t, e in rows if n == run and not e]
        for t in [t for n, t, e in rows if n == run and e]:
            hit = max((d for d in free if t - 2.5 < d < t), default=None)
            want.append((run, t, hit))
            if hit is not None:
                free.remove(hit)
    got = greedy.match_latest(df, ["run_name"], 2.5).where("is_event").collect()
    assert sorted((x["run_name"], x["time_s"], x["matched_time"]) for x in got) == sorted(want)
    lone = spark.range(50_000).selectExpr("'r' as run_name", "cast(id as double) as time_s", "false as is_event")
    assert greedy.match_latest(lone, ["run_name"], 3.0).where("not matched").count() == 50_000


def test_thresholds_consensus_and_optional_seconds(spark):
    assert alarms.parse_thresholds("0.25, 0.5 ,1") == (0.25, 0.5, 1.0)
    for bad in ("", "0.2,,0.4", "1.5", "-0.1"):
        with pytest.raises(ValueError):
            alarms.parse_thresholds(bad)
    alarms.checked_consensus(2, 3)
    for k, n in ((0, 1), (1, 0), (4, 3)):
        with pytest.raises(ValueError):
            alarms.checked_consensus(k, n)
    rows = spark.createDataFrame([(1, 1.25), (2, None), (3, 12.3456)], "i int, x double").select("i", alarms.optional_seconds(F.col("x")).alias("said")).orderBy("i").collect()
    assert [r["said"] for r in rows] == ["1.250s", "n/a", "12.346s"]
