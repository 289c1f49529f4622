"""Live alarms: k-of-n consensus and refractory suppression over a stream of scores.

State per run is the last n hits and the time of the last alarm, so it is bounded by n.
Rows of a run must reach the stream in the order of detection_time across micro-batches;
within one they are sorted here. For the same rows the alarms are those of
operators.alarms.detections and suppress.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.alarms import checked_consensus

OUTPUT = "run_name string, detection_time double, score double"
STATE = "hits array<int>, last double"


def live_alarms(scores: DataFrame, threshold: float = 0.5, k: int = 1, n: int = 1, refractory_s: float = 1.0) -> DataFrame:
    """A streaming DataFrame of alarms from one of (run_name, detection_time, score)."""
    checked_consensus(k, n)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits, last = state.get if state.exists else ([], None)
        hits = list(hits)
        rows = pd.concat(list(parts)).sort_values(["detection_time", "score"], kind="stable")
        out = []
        for t, score in zip(rows["detection_time"], rows["score"], strict=True):
            hits = [*hits, int(score >= threshold)][-n:]
            if sum(hits) >= k and (last is None or t - last > refractory_s):
                last = float(t)
                out.append((key[0], last, float(score)))
        state.update((hits, last))
        yield pd.DataFrame(out, columns=["run_name", "detection_time", "score"])

    typed = scores.selectExpr("cast(run_name as string) run_name", "cast(detection_time as double) detection_time", "cast(score as double) score")
    return typed.groupBy("run_name").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
