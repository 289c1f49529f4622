import json

import numpy as np
import pytest
from helpers import run_of
from pyspark.sql import functions as F

from millrace.functions.spectrum import SpectrogramConfig, frames, log_spectrogram, padded, standardized
from millrace.operators import cnn, forest, spectrograms
from millrace.plans.queries import FOREST
from millrace.sources import sinks


def test_arrays():
    assert [f.tolist() for f in frames(np.arange(8.0), 4, 2)] == [[0, 1, 2, 3], [2, 3, 4, 5], [4, 5, 6, 7]]
    assert padded(np.array([1.0, 2.0]), 5).tolist() == [1, 2, 0, 0, 0]
    assert not standardized(np.full((2, 3), 4.0)).any()
    assert log_spectrogram(np.zeros(0)).shape == (65, 0) and log_spectrogram(np.random.default_rng(0).normal(size=512)).shape == (65, 13)
    with pytest.raises(ValueError):
        log_spectrogram(np.zeros((2, 2)))
    with pytest.raises(ValueError):
        frames(np.zeros(4), 0, 1)


def test_labelled_spectrograms_keep_runs_apart(spark):
    both = run_of(spark, "a", audio=list(np.sin(np.arange(40.0)))).unionByName(run_of(spark, "b", audio=[0.0] * 40))
    w = spark.createDataFrame([("a", 20.0, 0, 20, 1), ("b", 20.0, 0, 20, -1)], "run_name string, detection_time double, start_index long, end_index long, label int")
    config = SpectrogramConfig(frame_size=8, hop_size=4)
    rows = {r["run_name"]: r for r in spectrograms.labeled_spectrograms(both, w, config).collect()}
    assert np.allclose(rows["a"]["spectrogram"], log_spectrogram(np.sin(np.arange(20.0)), config)) and rows["b"]["label"] == -1
    # Silence is flat, but its computed deviation need not be exactly 0: only then is the result all zeros.
    assert np.array(rows["b"]["spectrogram"]).std() in (pytest.approx(0), pytest.approx(1)) and len(rows["b"]["spectrogram"]) == 5
    with pytest.raises(ValueError):
        spectrograms.labeled_spectrograms(both, w.drop("label"))


def table(spark):
    r = np.random.default_rng(1)
    rows = [(f"run{i % 5}", float(i), float(x), float(y), int(x + y > 0)) for i, (x, y) in enumerate(r.normal(size=(300, 2)))] + [("run0", 999.0, 0.0, 0.0, -1)]
    return spark.createDataFrame(rows, "run_name string, detection_time double, x double, y double, label int")


def test_training_scoring_and_export(spark, tmp_path):
    data = table(spark)
    config = forest.ForestConfig(n_estimators=4, max_depth=3, min_samples_leaf=2)
    model = forest.train(data, config)
    scored = forest.predict(model, data).withColumn("hit", forest.predicted(F.col("score")))
    assert scored.where("label >= 0").agg(F.avg((F.col("hit") == F.col("label")).cast("int"))).first()[0] > 0.85
    nodes = forest.nodes(model, f"file://{tmp_path}/model")
    trees = forest.tree_arrays(nodes)
    # The nested CASE is the model: both score alike, but for thresholds in 32 bits.
    both = scored.withColumn("case", forest.forest_score(trees, [F.col("x"), F.col("y")]))
    assert both.where(F.abs(F.col("case") - F.col("score")) > 1e-9).count() <= 2
    size = forest.size_bytes(nodes).first()
    assert size["n_trees"] == 4 and size["model_bytes"] == 14 * sum(len(t["left"]) for t in trees)
    with pytest.raises(ValueError, match="lacks features"):
        forest.predict(model, data.drop("x"))
    for bad in (data.where("label = 1"), data.where("label = -1")):
        with pytest.raises(ValueError):
            forest.train(bad, config)
    with pytest.raises(ValueError):
        forest.predicted(F.col("score"), 1.5)


def test_folds_and_cross_validation(spark):
    data = table(spark)
    folds = {r["run_name"]: r["fold"] for r in forest.group_folds(data, 3).collect()}
    assert folds == {"run0": 0, "run1": 1, "run2": 2, "run3": 1, "run4": 2} or sorted(folds.values()) == [0, 1, 1, 2, 2]
    scored = forest.cross_validate(data, forest.ForestConfig(n_estimators=3, max_depth=3, n_splits=2))
    assert scored.count() == 300 and scored.where("score < 0 or score > 1").count() == 0
    with pytest.raises(ValueError):
        forest.group_folds(data.where("run_name = 'run1'"))
    weights = {r["label"]: r["weight"] for r in forest.balanced_weights(spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")).collect()}
    assert weights == {0: pytest.approx(2 / 3), 1: 2.0}


def test_artefacts(spark, tmp_path):
    made = json.loads(sinks.forest_json(FOREST, ["a", "b", "c"], "m", 112))
    assert len(made["trees"]) == 2 and made["trees"][1]["children_left"] == [1, -1, -1]
    header = sinks.forest_header(FOREST, ["a", "b", "c"], "m", 112)
    assert "#ifndef M_H" in header and "{1, 2, 0, 0.5f, 0.5f}" in header and "#define FOREST_TREE_COUNT 2" in header
    assert "PASS" in sinks.deployment_note("m", 2, 3, 111, 112) and "FAIL" in sinks.deployment_note("m", 2, 3, 112, 112)
    sinks.write_text(spark, f"file://{tmp_path}/x.txt", sinks.feature_list(["a", "b"]))
    assert (tmp_path / "x.txt").read_text() == "a\nb\n"


def test_cnn_needs_torch():
    with pytest.raises(ValueError):
        cnn.build(cnn.CNNConfig(base_channels=0))
    try:
        import torch
    except ImportError:
        with pytest.raises(ImportError):
            cnn.build()
    else:
        assert cnn.build()(torch.zeros(2, 1, 65, 12)).shape == (2, 2)
