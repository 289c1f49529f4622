import numpy as np
import pytest
from helpers import run_of

from millrace.functions.spectrum import spectral_block, spectral_names
from millrace.operators import features, windows
from millrace.operators.episodes import whole_runs


def span(spark, a, b):
    return spark.createDataFrame([("r", 0, a, b, b)], "run_name string, episode_ix int, start_time double, end_time double, extended_end_time double")


def cut(spark, signals, a, b, window, hop):
    return [(r["window_start"], r["window_end"], r["start_index"], r["end_index"]) for r in windows.sliding_windows(signals, span(spark, a, b), window, hop).orderBy("window_ix").collect()]


def test_windows(spark):
    half = run_of(spark, audio=[0, 1, 2, 3, 4], times=[0, 0.5, 1, 1.5, 2])
    assert cut(spark, half, 0.0, 2.0, 1.0, 0.5) == [(0, 1, 0, 2), (0.5, 1.5, 1, 3), (1, 2, 2, 4)]
    assert cut(spark, half, 0.5, 1.5, 0.5, 0.5) == [(0.5, 1, 1, 2), (1, 1.5, 2, 3)]
    assert windows.sample_rates(half).first()["sample_rate_hz"] == 2.0
    # The first test of an episode has no slack: .1 + .2 is over .3.
    tenths = run_of(spark, audio=[0] * 6, times=[i / 10 for i in range(6)])
    assert cut(spark, tenths, 0.1, 0.3, 0.2, 0.1) == []
    assert windows.sample_rates(run_of(spark, audio=[1, 2], times=[1.0, 1.0])).first()["sample_rate_hz"] == 0.0
    with pytest.raises(ValueError):
        windows.sliding_windows(half, whole_runs(half), 0, 1)


def test_time_features(spark):
    signals = run_of(spark, audio=[1, -1, 1, -1, 1], times=[0, 0.25, 0.5, 0.75, 1.0], VehicleSpeed=[2, 2, 3, 3, 4], CutLength=[9] * 5)
    whole = spark.createDataFrame([("r", 0, 0, 0.0, 1.0, 1.0, 0, 5)], "run_name string, episode_ix int, window_ix int, window_start double, window_end double, detection_time double, start_index long, end_index long")
    r = features.time_features(signals, whole).first()
    assert (r["sample_rate_hz"], r["audio_rms"], r["audio_peak_abs"], r["audio_zero_crossing_rate"], r["CutLength_mean"]) == (4, 1, 1, 4, 9)
    assert r["VehicleSpeed_mean"] == pytest.approx(2.8)
    zeros = features.time_features(run_of(spark, audio=[0.0, -0.0, 0.0], times=[0.0, 1.0, 2.0]), whole.selectExpr("run_name", "episode_ix", "window_ix", "window_start", "window_end", "detection_time", "start_index", "cast(3 as long) end_index")).first()
    assert zeros["audio_zero_crossing_rate"] == 1.0 and zeros["audio_crest_factor"] == 0.0 and "VehicleSpeed_mean" not in zeros


def test_long_windows_cross_position_chunks(spark, monkeypatch):
    monkeypatch.setattr(windows, "CHUNK", 3)
    signals = run_of(spark, audio=list(range(20)))
    cuts = windows.sliding_windows(signals, whole_runs(signals), 7.0, 2.0)
    got = {r["window_ix"]: r["audio"] for r in features.window_arrays(signals, cuts).collect()}
    assert got == {k: [float(x) for x in range(2 * k, 2 * k + 7)] for k in range(len(got))} and len(got) == 7


def test_deltas(spark):
    rows = [("a", 1.0, 2.0, 3.0), ("a", 0.0, 1.0, float("nan")), ("a", 0.5, 0.5, 1.0), ("b", 0.0, 7.0, None)]
    table = spark.createDataFrame(rows, "run_name string, detection_time double, audio_rms double, x double")
    got = {(r["run_name"], r["detection_time"]): (r["audio_rms_delta_1"], r["x_delta_1"]) for r in features.temporal_deltas(table).collect()}
    assert got == {("a", 0.0): (0, 0), ("a", 0.5): (-0.5, 0), ("a", 1.0): (1.5, 2.0), ("b", 0.0): (0, 0)}
    assert features.numeric_columns(table) == ["audio_rms", "x"]
    for bad in ({"lag": 0}, {"group": "none"}, {"order": "none"}):
        with pytest.raises(ValueError):
            features.temporal_deltas(table, **bad)


def test_spectrum():
    assert spectral_names()[:2] == ["band_energy_0_500_hz", "band_energy_500_2000_hz"]
    assert (spectral_block(np.array([[1.0, -1.0, 1.0, -1.0]]), np.array([4.0]), ((1000.0, 2000.0),))[0, 0]) == 0
    assert not spectral_block(np.full((1, 8), 3.0), np.array([8.0])).any() and not spectral_block(np.ones((1, 1)), np.array([1.0])).any()
    t = np.arange(256) / 8192.0
    tone = spectral_block(np.sin(2 * np.pi * 2560 * t)[None, :], np.array([8192.0]))[0]
    assert tone[2] > 0.999 and tone[-1] == pytest.approx(tone[2]) and abs(tone[-3] - 2560) < 1


def test_feature_table_columns(spark):
    signals = run_of(spark, audio=list(np.sin(np.arange(40.0))), VehicleSpeed=[1] * 40, CutLength=[2] * 40)
    table = features.temporal_deltas(features.feature_table(signals, windows.sliding_windows(signals, whole_runs(signals), 8.0, 4.0)))
    names = features.numeric_columns(table)
    assert len(names) == 36 and names[0] == "sample_rate_hz" and names[17] == "CutLength_std" and names[18] == "sample_rate_hz_delta_1"
    assert table.count() == 8


def test_timed_windows_stop_at_the_first_empty_one(spark):
    signals = run_of(spark, audio=[0] * 6, times=[0.0, 0.0, 0.5, 1.0, 3.5, 4.0])
    rows = [(r["window_start"], r["window_end"], r["start_index"], r["end_index"]) for r in windows.timed_windows(signals, span(spark, 0.0, 4.0), 1.0, 0.5).orderBy("window_ix").collect()]
    assert rows == [(0.0, 1.0, 0, 3), (0.5, 1.5, 2, 4), (1.0, 2.0, 3, 4)]
    assert windows.timed_windows(signals, span(spark, 0.0, 0.5), 1.0, 0.5).count() == 0
