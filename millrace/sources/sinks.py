"""Writers: runs, metadata, and the artefacts of an exported forest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: RAM of the target device, in bytes.
RAM_LIMIT = 2 * 1024 * 1024


def write_runs(signals: DataFrame, path: str) -> None:
    """Parquet partitioned by run."""
    signals.repartition("run_name").sortWithinPartitions("run_name", "pos").write.partitionBy("run_name").parquet(path)


def write_run_files(signals: DataFrame, directory: str) -> None:
    """One CSV file per run, named after it: written by the executors, then renamed."""
    spark = signals.sparkSession
    jvm = spark.sparkContext._jvm
    dealt = signals.repartition("run_name").sortWithinPartitions("run_name", "pos").drop("pos")
    dealt.write.partitionBy("run_name").option("header", True).csv(f"{directory}/_parts")
    parts = jvm.org.apache.hadoop.fs.Path(f"{directory}/_parts")
    fs = parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(parts):
        name = status.getPath().getName()
        if name.startswith("run_name="):
            (part,) = [f.getPath() for f in fs.listStatus(status.getPath()) if f.getPath().getName().endswith(".csv")]
            fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{directory}/{name.removeprefix('run_name=')}.csv"))
    fs.delete(parts, True)


def write_metadata_file(metadata: DataFrame, directory: str) -> None:
    """metadata.csv in the directory, with a header also where there is no event."""
    spark = metadata.sparkSession
    jvm = spark.sparkContext._jvm
    write_metadata(metadata, f"{directory}/_metadata")
    made = jvm.org.apache.hadoop.fs.Path(f"{directory}/_metadata")
    fs = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in fs.listStatus(made) if f.getPath().getName().endswith(".csv")]
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{directory}/metadata.csv"))
    fs.delete(made, True)


def write_metadata(metadata: DataFrame, path: str) -> None:
    """One CSV file with a header, also where there is no event; run_file names each run's file."""
    rows = metadata.withColumn("run_file", F.concat("run_name", F.lit(".csv")))
    rows.select("run_name", "event_time", "amplitude", "width_s", "vehicle_speed", "cut_length", "run_file").coalesce(1).write.option("header", True).csv(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, on any file system that Spark writes."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def forest_json(trees: list[dict], features: list[str], name: str, n_bytes: int) -> str:
    """trees: dicts of parallel arrays left, right, feature, threshold, value."""
    rows = [{"children_left": t["left"], "children_right": t["right"], "feature": t["feature"], "threshold": t["threshold"], "value": t["value"]} for t in trees]
    return json.dumps({"model_name": name, "feature_names": features, "n_classes": 2, "class_labels": [0, 1], "estimated_model_bytes": n_bytes, "trees": rows}, indent=2)


def forest_header(trees: list[dict], features: list[str], name: str, n_bytes: int, prefix: str = "forest") -> str:
    """A C header: node tables per tree, tables of trees, and inline functions that score a feature vector."""
    big = prefix.upper()
    guard = f"{name.upper()}_H"
    out = [
        f"#ifndef {guard}",
        f"#define {guard}",
        "",
        "#include <stdint.h>",
        "",
        "typedef struct { int16_t left; int16_t right; int16_t feature; float threshold; float value; } DecisionTreeNode;",
        "",
        f"#define {big}_TREE_COUNT {len(trees)}",
        f"#define {big}_FEATURE_COUNT {len(features)}",
        f"#define {big}_CLASS_COUNT 2",
        f"#define {big}_ESTIMATED_MODEL_BYTES {n_bytes}",
    ]

    def real(x: float) -> str:
        s = f"{x:.9g}"
        return f"{s}f" if any(c in s for c in ".en") else f"{s}.0f"

    for i, t in enumerate(trees):
        rows = zip(t["left"], t["right"], t["feature"], t["threshold"], t["value"], strict=True)
        out += ["", f"static const DecisionTreeNode {prefix}_tree_{i}[] = {{", *[f"    {{{a}, {b}, {f}, {real(x)}, {real(v)}}}," for a, b, f, x, v in rows], "};"]
    pointers = ", ".join(f"{prefix}_tree_{i}" for i in range(len(trees)))
    sizes = ", ".join(str(len(t["left"])) for t in trees)
    out += [
        "",
        f"static const DecisionTreeNode* const {prefix}_trees[] = {{{pointers}}};",
        f"static const uint16_t {prefix}_tree_node_counts[] = {{{sizes}}};",
        "",
        f"static inline float {prefix}_eval_tree(const DecisionTreeNode* nodes, const float* x) {{",
        "    int16_t at = 0;",
        "    while (nodes[at].left >= 0) at = x[nodes[at].feature] <= nodes[at].threshold ? nodes[at].left : nodes[at].right;",
        "    return nodes[at].value;",
        "}",
        "",
        f"static inline float {prefix}_predict_proba(const float* x) {{",
        "    float sum = 0.0f;",
        f"    for (uint16_t i = 0; i < {big}_TREE_COUNT; ++i) sum += {prefix}_eval_tree({prefix}_trees[i], x);",
        f"    return sum / (float){big}_TREE_COUNT;",
        "}",
        "",
        f"static inline uint8_t {prefix}_predict(const float* x, float threshold) {{ return {prefix}_predict_proba(x) >= threshold ? 1u : 0u; }}",
        "",
        f"#endif /* {guard} */",
        "",
    ]
    return "\n".join(out)


def feature_list(features: list[str]) -> str:
    return "\n".join(features) + "\n"


def deployment_note(name: str, n_trees: int, n_features: int, n_bytes: int, ram_limit: int = RAM_LIMIT) -> str:
    """A model fits only if it is strictly smaller than the limit."""
    verdict = "PASS" if n_bytes < ram_limit else "FAIL"
    return f"# {name}\n\n- trees: {n_trees}\n- features: {n_features}\n- estimated model bytes: {n_bytes}\n- RAM limit: {ram_limit} bytes\n- fit check: {verdict}\n"
