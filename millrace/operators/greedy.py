"""Order-dependent operators: one ordered pass over each group.

Groups are dealt by hash of their keys and sorted within partitions; a pass over a
partition keeps one group's state at a time, so no group is ever collected. A row without
a time comes to nothing: it is not kept, and matches nothing.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType


def thin(rows: DataFrame, keys: list[str], time: str, spacing_s: float, strict: bool, ties: tuple[str, ...] = ()) -> DataFrame:
    """The rows that greedy thinning keeps: each at least (strict: more than) spacing_s after the last one kept."""
    if spacing_s < 0:
        raise ValueError("Rows cannot be less than 0 seconds apart.")
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, time, *ties)
    names = list(ordered.columns)
    places, at = [names.index(k) for k in keys], names.index(time)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        last: float | None = None
        for batch in batches:
            keep = []
            for key, t in zip(zip(*[batch.column(i).to_pylist() for i in places], strict=True), batch.column(at).to_pylist(), strict=True):
                if key != group:
                    group, last = key, None
                good = t is not None and (last is None or (t - last > spacing_s if strict else t - last >= spacing_s))
                if good:
                    last = t
                keep.append(good)
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema)


def match_latest(rows: DataFrame, keys: list[str], horizon_s: float) -> DataFrame:
    """rows (keys, time_s, is_event) with matched and matched_time.

    In the order of time every event takes the latest detection, not yet taken, that lies
    strictly inside (its time - horizon_s, its time). Free detections wait in the order of
    their times: an event takes the latest, and those that no later event can reach are let
    go as soon as a later row comes, so no more of them wait than lie within one horizon.
    """
    if horizon_s <= 0:
        raise ValueError("Matching needs a horizon above 0 seconds.")
    # At equal times events come first: a detection must be strictly earlier.
    ordered = rows.select(*keys, "time_s", "is_event").repartition(*keys).sortWithinPartitions(*keys, "time_s", F.col("is_event").desc())
    schema = StructType([*ordered.schema.fields, StructField("matched", BooleanType()), StructField("matched_time", DoubleType())])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        waiting: deque[float] = deque()
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=[f.name for f in schema.fields])

        types: list[pa.DataType] = []
        for batch in batches:
            types = [*batch.schema.types, pa.bool_(), pa.float64()]
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key, t, event = row[:n], row[n], row[n + 1]
                if key != group:
                    out += [(*group, x, False, False, None) for x in waiting] if group is not None else []
                    group, waiting = key, deque()
                if t is None:
                    out.append((*row, False, None))
                    continue
                while waiting and waiting[0] <= t - horizon_s:
                    out.append((*key, waiting.popleft(), False, False, None))
                if not event:
                    waiting.append(t)
                elif waiting:
                    found = waiting.pop()
                    out.append((*row, True, found))
                    out.append((*key, found, False, True, t))
                else:
                    out.append((*row, False, None))
            if out:
                yield flush()
        out += [(*group, x, False, False, None) for x in waiting] if group is not None else []
        if out:
            yield flush()

    return ordered.mapInArrow(run, schema)
