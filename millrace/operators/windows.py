"""Sliding windows anchored at each episode's first sample, counted in samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.episodes import region_end
from millrace.operators.ranges import join_range

#: Slack of the comparison of a window's end with its region's.
END_SLACK = 1e-12


def sample_rates(signals: DataFrame) -> DataFrame:
    """run_name, n_rows and sample_rate_hz: 1 / the median positive time step, 0 without any."""
    order = Window.partitionBy("run_name").orderBy("pos")
    step = F.col("time_s") - F.lag("time_s").over(order)
    positive = F.when(F.col("step") > 0, F.col("step"))
    rates = signals.select("run_name", "pos", "time_s").withColumn("step", step).groupBy("run_name").agg(F.count(F.lit(1)).alias("n_rows"), F.percentile(positive, F.lit(0.5)).alias("median_step"))
    return rates.select("run_name", "n_rows", F.when(F.col("median_step") > 0, F.lit(1.0) / F.col("median_step")).otherwise(F.lit(0.0)).alias("sample_rate_hz"))


def sliding_windows(signals: DataFrame, episodes: DataFrame, window_s: float, hop_s: float, region: str = "header-on") -> DataFrame:
    """run_name, episode_ix, window_ix, window_start, window_end, detection_time, start_index, end_index (exclusive).

    A window covers round(window_s * rate) samples, the next one starts round(hop_s * rate)
    further on (half to even, 1 at least). Only anchors are rows here: samples that start no
    window leave with the filter.
    """
    if window_s <= 0 or hop_s <= 0:
        raise ValueError("Windows need a length and a hop above 0 seconds.")
    rates = (
        sample_rates(signals)
        .where("sample_rate_hz > 0")
        .select(
            F.col("run_name").alias("of_run"),
            "n_rows",
            F.greatest(F.lit(1), F.rint(F.col("sample_rate_hz") * window_s).cast("long")).alias("n_window"),
            F.greatest(F.lit(1), F.rint(F.col("sample_rate_hz") * hop_s).cast("long")).alias("n_hop"),
        )
    )
    # The first test has no slack, the one of each window has.
    spans = episodes.withColumn("region_end", region_end(region)).where(F.col("start_time") + window_s <= F.col("region_end"))
    spans = spans.join(rates, F.col("run_name") == F.col("of_run")).select("run_name", "episode_ix", F.col("start_time").alias("from_time"), "region_end", "n_rows", "n_window", "n_hop")
    samples = signals.select("run_name", "pos", "time_s")
    start, end = F.col("from_time"), F.col("region_end")
    anchors = join_range(samples, "time_s", spans, start, end, F.col("time_s").between(start, end), (samples, "time_s"))
    first = F.min("pos").over(Window.partitionBy("run_name", "episode_ix"))
    return (
        anchors.withColumn("first_pos", first)
        .where((F.col("pos") - F.col("first_pos")) % F.col("n_hop") == 0)
        .where((F.col("time_s") + window_s <= F.col("region_end") + END_SLACK) & (F.col("pos") + F.col("n_window") <= F.col("n_rows")))
        .select(
            "run_name",
            "episode_ix",
            ((F.col("pos") - F.col("first_pos")) / F.col("n_hop")).cast("int").alias("window_ix"),
            F.col("time_s").alias("window_start"),
            (F.col("time_s") + window_s).alias("window_end"),
            (F.col("time_s") + window_s).alias("detection_time"),
            F.col("pos").alias("start_index"),
            (F.col("pos") + F.col("n_window")).alias("end_index"),
        )
    )


def timed_windows(signals: DataFrame, episodes: DataFrame, window_s: float, hop_s: float, region: str = "header-on") -> DataFrame:
    """sliding_windows by time alone, for runs whose sample rate is unknown.

    Windows start every hop_s from the region's start and hold the samples of [start,
    start + window_s); an episode's windows end with the first that holds none.
    """
    if window_s <= 0 or hop_s <= 0:
        raise ValueError("Windows need a length and a hop above 0 seconds.")
    end = region_end(region)
    last = F.floor((end - F.col("start_time") - window_s + END_SLACK) / hop_s)
    starts = (
        episodes.where(last >= 0)
        .select("run_name", "episode_ix", "start_time", end.alias("region_end"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
        .withColumn("window_start", F.col("start_time") + F.col("k") * F.lit(float(hop_s)))
        .withColumn("window_end", F.col("window_start") + window_s)
        .where(F.col("window_end") <= F.col("region_end") + END_SLACK)
    )
    samples = signals.select("run_name", "pos", "time_s")
    inside = (F.col("time_s") >= F.col("window_start")) & (F.col("time_s") < F.col("window_end"))
    met = join_range(samples, "time_s", starts, F.col("window_start"), F.col("window_end"), inside, (samples, "time_s"), "left")
    held = met.groupBy("run_name", "episode_ix", "k", "window_start", "window_end").agg(F.min("pos").alias("start_index"), (F.max("pos") + 1).alias("end_index"))
    unbroken = Window.partitionBy("run_name", "episode_ix").orderBy("k")
    return (
        held.withColumn("empty", F.max(F.col("start_index").isNull().cast("int")).over(unbroken))
        .where("empty = 0")
        .select("run_name", "episode_ix", F.col("k").cast("int").alias("window_ix"), "window_start", "window_end", F.col("window_end").alias("detection_time"), "start_index", "end_index")
    )


#: Samples of a position chunk: what the join of samples and windows is keyed by besides the run.
CHUNK = 4096


def window_samples(signals: DataFrame, windows: DataFrame) -> DataFrame:
    """Every sample of every window: the window's keys and times beside the sample's columns.

    The join is keyed by (run, chunk of positions), so one long run spreads over as many
    tasks as it has chunks.
    """
    keyed = windows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start_index") / CHUNK), F.floor((F.col("end_index") - 1) / CHUNK)))).withColumnRenamed("run_name", "of_run")
    samples = signals.withColumn("of_chunk", F.floor(F.col("pos") / CHUNK))
    inside = (F.col("run_name") == F.col("of_run")) & (F.col("of_chunk") == F.col("chunk")) & (F.col("pos") >= F.col("start_index")) & (F.col("pos") < F.col("end_index"))
    return samples.join(keyed, inside).drop("of_run", "chunk", "of_chunk")
