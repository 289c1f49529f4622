import pytest
from pyspark.errors import PySparkException

from millrace.operators.status import normalize_status, validate, validation_report
from millrace.schema import DEFAULT, ChannelSchema, with_positions


def on(spark, values, kind):
    df = normalize_status(spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, Status {kind}"))
    return [r["HeaderOn"] for r in df.orderBy("i").collect()]


def test_statuses(spark):
    assert on(spark, [b"On", b"Off", b"On", b"\xff On \xfe"], "binary") == [True, False, True, True]
    assert on(spark, ["On", "Off", "true", "false", "1", "0", "\t yes\n", "1.0", "maybe"], "string") == [True, False, True, False, True, False, True, False, False]
    assert on(spark, [1.0, 0.0, float("nan"), -2.0], "double") == [True, False, True, True]
    assert on(spark, [1, 0], "int") == [True, False] and on(spark, [True, False], "boolean") == [True, False]


def test_unsupported_statuses(spark):
    with pytest.raises(PySparkException, match="cannot be null"):
        on(spark, ["On", None], "string")
    with pytest.raises(ValueError, match="cannot be a date"):
        normalize_status(spark.sql("SELECT date'2024-01-01' AS Status"))
    with pytest.raises(ValueError, match="No status channel"):
        normalize_status(spark.range(1))


def test_validation(spark):
    channels = ", ".join(f"{c} string" for c in DEFAULT.required)
    good = spark.createDataFrame([("r", 0, 0.0, *"abcde"), ("r", 1, 0.0, *"abcde"), ("r", 2, 1.0, *"abcde")], f"run_name string, pos long, time_s double, {channels}")
    validate(good)
    with pytest.raises(ValueError, match="empty"):
        validate(good.limit(0))
    with pytest.raises(ValueError, match="time_s"):
        validate(good.drop("time_s"))
    falling = spark.createDataFrame([("r", 0, 1.0), ("r", 1, 0.5)], "run_name string, pos long, time_s double")
    with pytest.raises(ValueError, match="fall"):
        validate(falling)
    with pytest.raises(ValueError, match="required but absent"):
        validate(good.drop("Sensor1"))
    assert [r["monotonic"] for r in validation_report(falling).collect()] == [False]


def test_positions_and_schema(spark):
    df = with_positions(spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 5.0)], "run_name string, time_s double"))
    assert {(r["run_name"], r["time_s"]): r["pos"] for r in df.collect()} == {("a", 1.0): 0, ("a", 2.0): 1, ("b", 5.0): 0}
    with pytest.raises(AttributeError):
        ChannelSchema().sensor = "x"
