"""Small tables for tests."""

from pyspark.sql import functions as F

from millrace.schema import with_positions


def run_of(spark, run="r", header=None, voltage=None, audio=None, times=None, **more):
    """signals of one run; samples a second apart unless times are given."""
    n = len(next(x for x in (header, voltage, audio) if x is not None))
    times = times or [float(i) for i in range(n)]
    rows = [(run, float(t), float(audio[i]) if audio else 0.0, float(voltage[i]) if voltage else 0.0, bool(header[i]) if header else True, *[float(v[i]) for v in more.values()]) for i, t in enumerate(times)]
    extra = "".join(f", {k} double" for k in more)
    return with_positions(spark.createDataFrame(rows, f"run_name string, time_s double, Sensor1 double, VoltageSignal double, HeaderOn boolean{extra}"))


def spans(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("run_name", *[F.col(c) for c in columns]).collect()]
