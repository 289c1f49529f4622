"""Random forests: training, run-grouped cross-validation, scoring, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.features import numeric_columns
from millrace.operators.labels import IGNORED, without_ignored

#: Bytes of an exported node: three 16-bit and two 32-bit fields, packed.
NODE_BYTES = 14
#: The deepest tree that the trainer accepts; None asks for it.
DEEPEST = 30


@dataclass(frozen=True)
class ForestConfig:
    n_estimators: int = 100
    max_depth: int | None = None
    min_samples_leaf: int = 1
    max_features: str = "sqrt"
    balanced: bool = True
    random_state: int = 42
    n_splits: int = 5


def training_rows(table: DataFrame) -> DataFrame:
    """Rows that are not ignored; raises unless both classes are there."""
    kept = without_ignored(table)
    found = sorted(r["label"] for r in kept.select("label").distinct().limit(3).collect())
    if not found:
        raise ValueError("No rows to train on.")
    if found != [0, 1]:
        raise ValueError(f"Training needs labels 0 and 1, got {found}.")
    return kept


def balanced_weights(table: DataFrame) -> DataFrame:
    """label and weight: rows / (2 * rows of the class)."""
    counts = table.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # Two rows meet one: the class counts and their sum.
    return counts.join(F.broadcast(total)).select("label", (F.col("total") / (2.0 * F.col("n"))).alias("weight"))


def train(table: DataFrame, config: ForestConfig = ForestConfig(), features: list[str] | None = None) -> PipelineModel:  # noqa: B008
    rows = training_rows(table)
    names = features or numeric_columns(table)
    if not names:
        raise ValueError("No feature columns.")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    if config.balanced:
        weight = F.when(F.col("label") == 1, F.lit(total / (2.0 * counts[1]))).otherwise(F.lit(total / (2.0 * counts[0])))
    forest = RandomForestClassifier(
        labelCol="label",
        featuresCol="features",
        weightCol="weight",
        numTrees=config.n_estimators,
        maxDepth=DEEPEST if config.max_depth is None else min(DEEPEST, config.max_depth),
        minInstancesPerNode=config.min_samples_leaf,
        featureSubsetStrategy=config.max_features,
        impurity="gini",
        seed=config.random_state,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"), forest]).fit(rows.withColumn("weight", weight))


def feature_names(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def predict(model: PipelineModel, table: DataFrame) -> DataFrame:
    """table with score: the mean share of the positive class over trees."""
    if missing := [c for c in feature_names(model) if c not in table.columns]:
        raise ValueError(f"The table lacks features of the model: {missing}")
    return model.transform(table).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def predicted(score: Column, threshold: float = 0.5) -> Column:
    if not 0 <= threshold <= 1:
        raise ValueError("A score threshold lies between 0 and 1.")
    return (score >= threshold).cast("int")


def group_folds(table: DataFrame, n_splits: int = 5, group: str = "run_name") -> DataFrame:
    """run_name, n_rows, fold: groups by falling size (then name), each to the lightest fold (then the lowest).

    One row a run is all that the driver sees.
    """
    sizes = [(r[group], r["n"]) for r in table.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()]
    if len(sizes) < 2:
        raise ValueError("Grouped cross-validation needs two runs at least.")
    loads = [0] * min(n_splits, len(sizes))
    rows = []
    for name, n in sorted(sizes, key=lambda s: (-s[1], s[0])):
        fold = loads.index(min(loads))
        loads[fold] += n
        rows.append((name, n, fold))
    return table.sparkSession.createDataFrame(rows, f"{group} string, n_rows long, fold int")


def cross_validate(table: DataFrame, config: ForestConfig = ForestConfig(), folds: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """run_name, detection_time, label, score, fold of every row that is not ignored, scored by a forest of the other folds."""
    folds = (folds if folds is not None else group_folds(table, config.n_splits)).select("run_name", "fold")
    rows = table.join(folds, "run_name")  # one row a run: Catalyst broadcasts them while they are small
    features = numeric_columns(table)
    out = None
    for fold in range(folds.agg(F.max("fold")).first()[0] + 1):
        model = train(rows.where(F.col("fold") != fold).drop("fold"), config, features)
        scored = predict(model, rows.where(F.col("fold") == fold)).where(F.col("label") != IGNORED).select("run_name", "detection_time", "label", "score", "fold")
        out = scored if out is None else out.unionByName(scored)
    return out


def nodes(model: PipelineModel, path: str) -> DataFrame:
    """tree_id, node_id, left_child, right_child, feature, threshold, value of a forest, read from its saved form at path."""
    forest: RandomForestClassificationModel = model.stages[-1]
    spark = SparkSession.getActiveSession()
    forest.write().overwrite().save(path)
    raw = spark.read.parquet(f"{path}/data")
    rows = raw.select(F.col("treeID").alias("tree_id"), "nodeData.*")
    stats = F.col("impurityStats")
    leaf = F.col("leftChild") < 0
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "tree_id",
        F.col("id").alias("node_id"),
        F.col("leftChild").alias("left_child"),
        F.col("rightChild").alias("right_child"),
        F.when(leaf, F.lit(-2)).otherwise(F.col("split.featureIndex")).alias("feature"),
        F.when(leaf, F.lit(-2.0)).otherwise(F.element_at(F.col("split.leftCategoriesOrThreshold"), 1)).alias("threshold"),
        F.when(total > 0, F.element_at(stats, -1) / F.when(total > 0, total)).otherwise(F.lit(0.0)).alias("value"),
    )


def size_bytes(forest: DataFrame) -> DataFrame:
    """n_trees, n_nodes and the estimated bytes of an exported forest."""
    return forest.agg(F.count_distinct("tree_id").alias("n_trees"), F.count(F.lit(1)).alias("n_nodes"), (F.count(F.lit(1)) * NODE_BYTES).alias("model_bytes"))


def tree_arrays(forest: DataFrame) -> list[dict]:
    """Per tree its parallel arrays in node order; a forest is small by design, so this is for the driver."""
    trees: dict[int, list] = {}
    for r in forest.orderBy("tree_id", "node_id").collect():
        trees.setdefault(r["tree_id"], []).append(r)
    fields = {"left": "left_child", "right": "right_child", "feature": "feature", "threshold": "threshold", "value": "value"}
    return [{k: [r[c] for r in rows] for k, c in fields.items()} for _, rows in sorted(trees.items())]


def tree_score(tree: dict, features: list[Column], at: int = 0) -> Column:
    """A tree as nested CASE WHEN, which Catalyst compiles; thresholds are 32-bit floats as exported."""
    left, right = tree["left"][at], tree["right"][at]
    if left < 0 or right < 0:
        return F.lit(float(tree["value"][at]))
    goes_left = features[tree["feature"][at]].cast("float") <= F.lit(float(tree["threshold"][at])).cast("float")
    return F.when(goes_left, tree_score(tree, features, left)).otherwise(tree_score(tree, features, right))


def forest_score(trees: list[dict], features: list[Column]) -> Column:
    """The mean of all trees' leaf values."""
    if not trees:
        raise ValueError("The forest has no trees.")
    return sum((tree_score(t, features) for t in trees[1:]), tree_score(trees[0], features)) / float(len(trees))
