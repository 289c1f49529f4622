"""Names of channels and the schemas of the tables that operators exchange.

All runs are rows of one table, `signals`, with a leading run_name; a row's place in its
run is an explicit `pos`, counted from 0 by time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChannelSchema:
    """Physical column names of the logical channels."""

    sensor: str = "Sensor1"
    vehicle_speed: str = "VehicleSpeed"
    cut_length: str = "CutLength"
    voltage: str = "VoltageSignal"
    status: str = "Status"
    header_on: str = "HeaderOn"

    @property
    def required(self) -> tuple[str, ...]:
        return (self.sensor, self.vehicle_speed, self.cut_length, self.voltage, self.status)


DEFAULT = ChannelSchema()

EPISODES = "run_name string, episode_ix int, start_time double, end_time double, extended_end_time double"
EVENTS = (
    "run_name string, start_time double, peak_time double, end_time double, peak_voltage double, "
    "threshold double, episode_start_time double, episode_end_time double, source string"
)


def with_positions(signals: DataFrame, *ties: str) -> DataFrame:
    """signals with pos; `ties` order rows of equal time."""
    order = Window.partitionBy("run_name").orderBy("time_s", *ties)
    return signals.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def require(df: DataFrame, columns: set[str], what: str) -> None:
    """Raises ValueError where columns are absent; looks at the schema alone."""
    if missing := sorted(columns - set(df.columns)):
        raise ValueError(f"Missing {what}: {', '.join(missing)}")
