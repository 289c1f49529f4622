"""Status normalisation and structural validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, NumericType, StringType

from millrace.schema import DEFAULT, ChannelSchema

#: Texts that mean "on", after trimming and lower-casing.
ON_WORDS = ("on", "1", "true", "yes")


def _truth(status: Column, kind) -> Column:
    if isinstance(kind, BooleanType):
        return status
    if isinstance(kind, BinaryType):
        # Malformed bytes are dropped, so they never turn into replacement characters.
        return _truth(F.replace(F.make_valid_utf8(status.cast("string")), F.lit("�"), F.lit("")), StringType())
    if isinstance(kind, StringType):
        return F.lower(F.regexp_replace(status, r"^\s+|\s+$", "")).isin(*ON_WORDS)
    if isinstance(kind, NumericType):
        # NaN counts as true, like every number but zero.
        return status.cast("double") != 0.0
    raise ValueError(f"A status cannot be a {kind.simpleString()}")


def normalize_status(signals: DataFrame, schema: ChannelSchema = DEFAULT) -> DataFrame:
    """signals with the boolean header column; the status column stays. Null status raises when a row is read."""
    if schema.status not in signals.columns:
        raise ValueError(f"No status channel {schema.status}")
    status = F.col(schema.status)
    on = _truth(status, signals.schema[schema.status].dataType)
    refuse = F.raise_error(F.lit("A status cannot be null")).cast("boolean")
    return signals.withColumn(schema.header_on, F.when(status.isNull(), refuse).otherwise(on))


def validation_report(signals: DataFrame) -> DataFrame:
    """Per run: rows and whether its times never fall in the order of pos (one pass)."""
    order = Window.partitionBy("run_name").orderBy("pos")
    step = F.col("time_s") - F.lag("time_s").over(order)
    return signals.withColumn("step", step).groupBy("run_name").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.min("step") >= 0, F.lit(True)).alias("monotonic"))


def validate(signals: DataFrame, schema: ChannelSchema = DEFAULT) -> None:
    """Raises ValueError for an empty table, no time column, falling times or absent channels, in that order."""
    if signals.isEmpty():
        raise ValueError("No samples to validate: the table is empty.")
    if "time_s" not in signals.columns:
        raise ValueError("Samples need a time_s column.")
    if not validation_report(signals).where(~F.col("monotonic")).isEmpty():
        raise ValueError("Measurement times must not fall.")
    if missing := [c for c in schema.required if c not in signals.columns]:
        raise ValueError(f"Channels that are required but absent: {', '.join(missing)}")
