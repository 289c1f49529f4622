import json
import os
import re
import shutil
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.schema import ChannelSchema
from millrace.plans.pipelines import PipelineConfig, export_forest, labeled_features
from millrace.operators import events
from millrace.sources import files, sinks, synthetic


def test_generator_invariants():
    config = synthetic.RunConfig(duration_s=10, sample_rate_hz=100, header_on_start_s=1, header_on_end_s=9)
    a, b = synthetic.generate_run(config), synthetic.generate_run(config)
    assert len(a[0]) == 1001 and a[0].equals(b[0]) and a[1].equals(b[1])
    busy, found = synthetic.generate_run(synthetic.RunConfig(duration_s=30, sample_rate_hz=200, header_on_start_s=1, header_on_end_s=29, event_rate_per_minute=20))
    assert len(found) and busy["VoltageSignal"].max() > 100 and np.diff(found["event_time"]).min(initial=9) >= 3
    assert synthetic.spaced(np.array([1, 2, 4.5, 8]), 3.0) == [1, 4.5, 8]
    t = np.arange(0, 5, 0.01)
    made = synthetic.precursor(t, 3.0, 1.0, 0.5, np.random.default_rng(0))
    assert not made[(t < 2.5) | (t > 3.0)].any() and made.any()
    state = np.random.default_rng(0)
    assert not synthetic.precursor(t, -9.0, 1.0, 0.5, state).any() and state.random() == np.random.default_rng(0).random()
    for bad in ({"duration_s": 0}, {"sample_rate_hz": 0}, {"header_on_end_s": 1.0}, {"noise_std": -1}, {"event_rate_per_minute": -1}):
        with pytest.raises(ValueError):
            synthetic.generate_run(synthetic.RunConfig(**bad))
    with pytest.raises(ValueError):
        synthetic.run_configs(0)


def test_dataset_round_trip_through_files(spark, tmp_path):
    signals, metadata = synthetic.generate_dataset(spark, synthetic.run_configs(2, duration_s=8, sample_rate_hz=50, event_rate_per_minute=30))
    frames = {r["run_name"]: r["n"] for r in signals.groupBy("run_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert frames == {"synthetic_run_000": 401, "synthetic_run_001": 401}
    runs = tmp_path / "runs"
    runs.mkdir()
    sinks.write_run_files(signals, f"file://{runs}")
    assert sorted(p.name for p in runs.glob("[!.]*")) == [f"{n}.csv" for n in sorted(frames)]
    read = files.read_runs(spark, f"file://{runs}")
    assert read.count() == 802 and files.read_runs(spark, f"file://{runs}", 1).select("run_name").distinct().count() == 1
    both = read.alias("a").join(signals.alias("b"), ["run_name", "pos"]).where(F.abs(F.col("a.Sensor1") - F.col("b.Sensor1")) > 1e-9)
    assert both.count() == 0
    sinks.write_metadata_file(metadata, f"file://{tmp_path}")
    assert (tmp_path / "metadata.csv").read_text().startswith("run_name,event_time,amplitude,width_s,vehicle_speed,cut_length,run_file")
    again = files.read_metadata(spark, f"file://{tmp_path}", ["synthetic_run_001"])
    assert again.count() == metadata.where("run_name = 'synthetic_run_001'").count()
    sinks.write_runs(signals, f"file://{tmp_path}/parquet")
    assert spark.read.parquet(f"file://{tmp_path}/parquet").count() == 802
    with pytest.raises(ValueError):
        files.read_runs(spark, f"file://{runs}", 0)
    with pytest.raises(FileNotFoundError):
        files.read_runs(spark, f"file://{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        files.read_measurements(spark, f"file://{runs}")
    with pytest.raises(NotADirectoryError):
        files.list_files(spark, f"file://{runs}/synthetic_run_000.csv", ".csv")


def test_resample(spark):
    df = spark.createDataFrame([("r", 0.0, 0.0, "a"), ("r", 1.0, 10.0, "b"), ("r", 3.0, 30.0, "c")], "run_name string, time_s double, x double, s string")
    rows = files.resample(df, 0.5, ["x"], ["s"]).orderBy("pos").collect()
    assert [r["time_s"] for r in rows] == [i / 2 for i in range(7)]
    assert [r["x"] for r in rows] == pytest.approx([0, 5, 10, 15, 20, 25, 30]) and [r["s"] for r in rows] == ["a", "a", "b", "b", "b", "b", "c"]


def test_export_of_a_compact_forest(spark, tmp_path):
    signals, metadata = synthetic.generate_dataset(spark, synthetic.run_configs(2, duration_s=20, sample_rate_hz=100, event_rate_per_minute=20))
    labeled, seconds = labeled_features(signals.persist(), events.with_ratio(events.metadata_to_events(metadata)), PipelineConfig())
    assert seconds.count() == 2
    nodes = export_forest(spark, labeled.persist(), f"file://{tmp_path}/out")
    assert nodes.select("tree_id").distinct().count() == 8
    assert (tmp_path / "out/feature_order.txt").read_text().count("\n") == 36
    note, header, model = ((tmp_path / f"out/{n}").read_text() for n in ("README.md", "early_warning_forest.h", "early_warning_forest.json"))
    size = nodes.count() * 14
    assert "PASS" in note and f"estimated model bytes: {size}" in note and "FAIL" in sinks.deployment_note("m", 1, 1, sinks.RAM_LIMIT)
    parsed = json.loads(model)
    assert parsed["estimated_model_bytes"] == size and len(parsed["feature_names"]) == 36 and sum(len(t["feature"]) for t in parsed["trees"]) == nodes.count()
    assert "#define FOREST_TREE_COUNT 8" in header and header.count("static const DecisionTreeNode forest_tree_") == 8


def test_command_line_generates_evaluates_and_exports(spark, tmp_path, capsys):
    from millrace import cli

    home = f"file://{tmp_path}/data"
    cli.main(["generate", home, "--n-runs", "2", "--duration-s", "12", "--sample-rate-hz", "50", "--event-rate-per-minute", "30"], spark)
    cli.main(["evaluate-directory", home, "--trees", "4", "--depth", "3", "--n-splits", "2", "--threshold-sweep", "0.2,0.6", "--score-threshold", "0.4"], spark)
    cli.main(["export", home, f"file://{tmp_path}/out", "--window-s", "1", "--hop-s", "0.5", "--positive-horizon-s", "2", "--seed", "7"], spark)
    said = capsys.readouterr().out
    assert "true_positive_rate" in said and "n_positive" in said and "|0.4 " in said and (tmp_path / "out/feature_order.txt").exists()
    with pytest.raises(SystemExit):
        cli.main(["unknown"], spark)


def test_the_c_header_scores_like_the_forest(spark, tmp_path):
    """The emitted header, compiled, gives the scores of forest_score on random feature vectors; without a compiler its node tables are walked."""
    from millrace.operators import forest
    from millrace.plans.queries import FOREST

    names = ["a", "b", "c"]
    text = sinks.forest_header(FOREST, names, "small_forest", 112)
    (tmp_path / "small_forest.h").write_text(text)
    r = np.random.default_rng(2)
    rows = np.concatenate([r.normal(0, 60, (60, 3)), [[0.5, 90.0, 4.0], [0.5, 90.5, 4.5]]]).astype(np.float32)
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rows)], "i int, a double, b double, c double")
    want = [x["score"] for x in df.select("i", forest.forest_score(FOREST, [F.col(n) for n in names]).alias("score")).orderBy("i").collect()]
    compiler = shutil.which("cc") or shutil.which("gcc")
    (tmp_path / "empty.c").write_text("int main(void) { return 0; }\n")
    works = compiler and subprocess.run([compiler, "-o", str(tmp_path / "empty"), str(tmp_path / "empty.c")], capture_output=True, timeout=60).returncode == 0
    if works:
        vectors = ", ".join("{" + ", ".join(float(v).hex() + "f" for v in x) + "}" for x in rows)
        (tmp_path / "main.c").write_text(
            f'#include <stdio.h>\n#include "small_forest.h"\nstatic const float x[][3] = {{{vectors}}};\nint main(void) {{ for (int i = 0; i < {len(rows)}; ++i) printf("%.9g %d\\n", forest_predict_proba(x[i]), forest_predict(x[i], 0.5f)); return 0; }}\n'
        )
        subprocess.run([compiler, "-Wall", "-Werror", "-o", str(tmp_path / "main"), str(tmp_path / "main.c")], check=True, timeout=60)
        lines = subprocess.run([str(tmp_path / "main")], capture_output=True, text=True, check=True, timeout=60).stdout.split("\n")[:-1]
        got = [(float(a), int(b)) for a, b in (line.split() for line in lines)]
    else:
        tables = [[tuple(map(float, n.replace("f", "").split(","))) for n in re.findall(r"\{([^{}]+)\},", t)] for t in re.findall(r"DecisionTreeNode forest_tree_\d+\[\] = \{(.*?)\n\};", text, re.S)]

        def walk(nodes: list, x) -> float:
            at = 0
            while nodes[at][0] >= 0:
                at = int(nodes[at][0] if x[int(nodes[at][2])] <= np.float32(nodes[at][3]) else nodes[at][1])
            return nodes[at][4]

        scores = [sum(walk(t, x) for t in tables) / len(tables) for x in rows]
        got = [(s, int(s >= 0.5)) for s in scores]
    assert [s for s, _ in got] == pytest.approx(want, abs=1e-6) and [p for _, p in got] == [int(s >= 0.5) for s in want]


@pytest.fixture
def measurements(tmp_path, monkeypatch):
    """Measurement files, and a stand-in for the package that reads them: a file holds its frame as JSON."""
    package = tmp_path / "package"
    package.mkdir()
    (package / "asammdf.py").write_text(
        "import json, pandas as pd\n"
        "class MDF:\n"
        "    def __init__(self, path):\n"
        "        self.data = json.load(open(path.removeprefix('file:')))\n"
        "    def __enter__(self): return self\n"
        "    def __exit__(self, *error): pass\n"
        "    def to_dataframe(self, channels, raster, time_from_zero):\n"
        "        assert time_from_zero\n"
        "        frame = pd.DataFrame({c: v for c, v in self.data['channels'].items() if c in channels}, index=self.data['time'])\n"
        "        return frame.iloc[::int(raster)] if raster else frame\n"
    )
    monkeypatch.setenv("PYTHONPATH", f"{package}:{os.environ['PYTHONPATH']}")
    monkeypatch.syspath_prepend(str(package))
    home = tmp_path / "files"
    home.mkdir()

    def write(name: str, time: list, **channels) -> str:
        (home / f"{name}.mf4").write_text(json.dumps({"time": time, "channels": channels}))
        return f"file://{home}"

    return write


def test_measurement_scan(spark, measurements, monkeypatch):
    monkeypatch.setattr(files, "BATCH_ROWS", 2)
    package = os.environ["PYTHONPATH"].split(":")[0]
    spark.sparkContext.addPyFile(f"{package}/asammdf.py")
    some = {"Sensor1": [1, 2, 3], "VehicleSpeed": [4, 5, 6], "CutLength": [7, 8, 9], "VoltageSignal": [1.5, 2.5, 3.5]}
    measurements("b", [0.5, 0.0, 1.0], **some, Status=["On", "Off", "On"], Other=[0, 0, 0])
    home = measurements("a", [0.0, 1.0, 2.0], **some, Status=[1, 0, 1])
    rows = [tuple(r) for r in files.read_measurements(spark, home).orderBy("run_name", "pos").select("run_name", "pos", "time_s", "Sensor1", "VoltageSignal", "HeaderOn").collect()]
    assert rows == [("a", 0, 0.0, 1.0, 1.5, True), ("a", 1, 1.0, 2.0, 2.5, False), ("a", 2, 2.0, 3.0, 3.5, True), ("b", 0, 0.0, 2.0, 2.5, False), ("b", 1, 0.5, 1.0, 1.5, True), ("b", 2, 1.0, 3.0, 3.5, True)]
    assert files.read_measurements(spark, home, raster=2.0).count() == 4
    # A reader that is given a schema reads its channels alone, in its order and types.
    paths = ",".join(files.list_files(spark, home, ".mf4"))
    few = spark.read.format("millrace_mf4").schema("Sensor1 float, run_name string").option("paths", paths).load()
    assert few.columns == ["Sensor1", "run_name"] and sorted(map(tuple, few.collect())) == [(x, n) for x in (1.0, 2.0, 3.0) for n in "ab"]
    # Channels of other names.
    named = ChannelSchema(sensor="Mic", vehicle_speed="V", cut_length="L", voltage="U", status="S", header_on="On")
    measurements("a", [0.0], Mic=[1], V=[2], L=[3], U=[4], S=["yes"])
    with pytest.raises(Exception, match="no channels Mic"):
        files.read_measurements(spark, home, schema=named)
    measurements("b", [0.0], Mic=[1], V=[2], L=[3], U=[4], S=["no"])
    assert [(r["Mic"], r["On"]) for r in files.read_measurements(spark, home, schema=named).orderBy("run_name").collect()] == [(1.0, True), (1.0, False)]
    measurements("b", [], Mic=[], V=[], L=[], U=[], S=[])
    with pytest.raises(ValueError, match="No samples"):
        files.read_measurements(spark, home, schema=named)
    assert files.read_measurements(spark, home, schema=named, validated=False).count() == 1
