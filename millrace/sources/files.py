"""Runs and metadata from CSV files; measurement files through a Python data source."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, DataType, DoubleType, StringType, StructField, StructType

from millrace.operators.status import normalize_status, validate
from millrace.schema import DEFAULT, ChannelSchema, with_positions

RUN_CSV = "time_s double, Sensor1 double, VehicleSpeed double, CutLength double, VoltageSignal double, Status string, HeaderOn boolean"
METADATA_CSV = "run_name string, event_time double, amplitude double, width_s double, vehicle_speed double, cut_length double, run_file string"


def list_files(spark: SparkSession, directory: str, suffix: str, prefix: str = "") -> list[str]:
    """Sorted paths of the directory's files with that prefix and suffix, on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(directory)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(f"No such directory: {directory}")
    if not fs.getFileStatus(at).isDirectory():
        raise NotADirectoryError(f"Not a directory: {directory}")
    found = [s.getPath() for s in fs.listStatus(at) if s.isFile()]
    return sorted(str(p) for p in found if p.getName().endswith(suffix) and p.getName().startswith(prefix))


def read_runs(spark: SparkSession, directory: str, max_runs: int | None = None, prefix: str = "synthetic_run_") -> DataFrame:
    """All run files of a directory as signals; max_runs takes the first by name, before anything is read."""
    paths = list_files(spark, directory, ".csv", prefix)
    if max_runs is not None:
        if max_runs <= 0:
            raise ValueError("At least one run has to be read.")
        paths = paths[:max_runs]
    if not paths:
        raise FileNotFoundError(f"No run files in {directory}")
    rows = spark.read.schema(RUN_CSV).option("header", True).csv(paths)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    return with_positions(rows.withColumn("run_name", stem).select("run_name", *rows.columns))


def read_metadata(spark: SparkSession, directory: str, allowed_runs: list[str] | None = None) -> DataFrame:
    rows = spark.read.schema(METADATA_CSV).option("header", True).csv(f"{directory}/metadata.csv")
    return rows if allowed_runs is None else rows.where(F.col("run_name").isin(allowed_runs))


def resample(signals: DataFrame, raster: float, linear: list[str], steps: list[str] = []) -> DataFrame:  # noqa: B006
    """signals on a common grid of `raster` seconds from each run's first sample.

    `linear` channels are interpolated between the samples around a grid time, `steps`
    channels keep the last value. Grid times and samples are united and two windows per run
    carry the neighbours across: an as-of join without a join.
    """
    from pyspark.sql import Window

    if raster <= 0:
        raise ValueError("A raster is longer than 0 seconds.")
    spans = signals.groupBy("run_name").agg(F.min("time_s").alias("a"), F.max("time_s").alias("b"))
    ticks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a")) / raster + 1e-9))
    grid = spans.select("run_name", "a", F.explode(ticks).alias("k")).select("run_name", (F.col("a") + F.col("k") * raster).alias("time_s"), F.lit(True).alias("tick"))
    samples = signals.select("run_name", "time_s", F.lit(False).alias("tick"), *linear, *steps)
    united = grid.unionByName(samples, allowMissingColumns=True)
    order = Window.partitionBy("run_name").orderBy("time_s", F.col("tick").asc())
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    future = order.rowsBetween(0, Window.unboundedFollowing)
    when = F.when(~F.col("tick"), F.col("time_s"))
    out = united.withColumn("t0", F.last(when, True).over(past)).withColumn("t1", F.first(when, True).over(future))
    for c in linear:
        v0, v1 = F.last(F.col(c), True).over(past), F.coalesce(F.first(F.col(c), True).over(future), F.last(F.col(c), True).over(past))
        share = F.when(F.col("t1") > F.col("t0"), (F.col("time_s") - F.col("t0")) / F.when(F.col("t1") > F.col("t0"), F.col("t1") - F.col("t0"))).otherwise(F.lit(0.0))
        out = out.withColumn(f"_{c}", v0 + (v1 - v0) * share)
    for c in steps:
        out = out.withColumn(f"_{c}", F.last(F.col(c), True).over(past))
    return with_positions(out.where("tick").select("run_name", "time_s", *[F.col(f"_{c}").alias(c) for c in [*linear, *steps]]))


class MeasurementSource(DataSource):
    """`spark.read.format("millrace_mf4")`: one partition per measurement file.

    Options: paths (separated by commas), raster (seconds), schema (the fields of a
    ChannelSchema as JSON). The columns are run_name, time_s and the required channels, or,
    where the reader is given a schema, those of its columns: channels that it does not name
    are not read from the files. Needs the optional asammdf package where it is read.
    """

    @classmethod
    def name(cls) -> str:
        return "millrace_mf4"

    def channels(self) -> ChannelSchema:
        return ChannelSchema(**json.loads(self.options.get("schema", "{}")))

    def schema(self) -> StructType:
        names = self.channels()
        kinds = [(c, BinaryType() if c == names.status else DoubleType()) for c in names.required]
        return StructType([StructField("run_name", StringType()), StructField("time_s", DoubleType()), *[StructField(c, k) for c, k in kinds]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return MeasurementReader(self.options, schema)


class MeasurementReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.raster = float(options["raster"]) if options.get("raster") else None
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """The file's samples in the order of time, as Arrow batches of BATCH_ROWS rows."""
        import os

        from asammdf import MDF

        asked = [f for f in self.schema.fields if f.name not in ("run_name", "time_s")]
        with MDF(partition.value) as mdf:
            frame = mdf.to_dataframe(channels=[f.name for f in asked], raster=self.raster, time_from_zero=True).sort_index(kind="stable")
        if absent := [f.name for f in asked if f.name not in frame.columns]:
            raise ValueError(f"{partition.value} has no channels {', '.join(absent)}")
        stem = os.path.splitext(os.path.basename(partition.value))[0]
        for at in range(0, len(frame), BATCH_ROWS):
            part = frame.iloc[at : at + BATCH_ROWS]
            made = {"run_name": pa.array([stem] * len(part)), "time_s": pa.array(part.index.to_numpy(dtype=float))}
            made |= {f.name: _arrow(part[f.name], f.dataType) for f in asked}
            yield pa.RecordBatch.from_arrays([made[f.name] for f in self.schema.fields], names=[f.name for f in self.schema.fields])


#: Rows of an Arrow batch that the reader hands over.
BATCH_ROWS = 65_536


def _arrow(values, kind: DataType) -> pa.Array:
    """A channel of a data frame as the column type that was asked for; texts and numbers become bytes as they are written."""
    if isinstance(kind, BinaryType):
        return pa.array([None if v is None else bytes(v) if isinstance(v, (bytes, bytearray)) else str(v).encode() for v in values], type=pa.binary())
    if isinstance(kind, StringType):
        return pa.array([None if v is None else v.decode("utf-8", "ignore") if isinstance(v, bytes) else str(v) for v in values], type=pa.string())
    return pa.array(values.to_numpy(dtype=float)).cast(to_arrow_type(kind))


def read_measurements(spark: SparkSession, directory: str, raster: float | None = None, schema: ChannelSchema = DEFAULT, validated: bool = True) -> DataFrame:
    """All measurement files of a directory as signals with the header column.

    validated: each run's file has samples, its times do not fall and its channels are
    there, or ValueError is raised, as the files are read once for it; pass False where the
    caller validates what it stores.
    """
    paths = list_files(spark, directory, ".mf4")
    if not paths:
        raise FileNotFoundError(f"No measurement files in {directory}")
    spark.dataSource.register(MeasurementSource)
    reader = spark.read.format("millrace_mf4").option("paths", ",".join(paths)).option("schema", json.dumps(asdict(schema)))
    rows = with_positions((reader.option("raster", str(raster)) if raster else reader).load())
    if validated:
        validate(rows, schema)
        # A file without samples has no rows that a report over all runs could show.
        seen = {r["run_name"] for r in rows.select("run_name").distinct().collect()}  # one name a file of the list above
        if empty := sorted(p for p in paths if p.rpartition("/")[2].rpartition(".")[0] not in seen):
            raise ValueError(f"No samples in {', '.join(empty)}")
    return normalize_status(rows, schema)
