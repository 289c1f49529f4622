"""Log-power spectrograms of windows as nested arrays, and their framing in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from millrace.functions.spectrum import SpectrogramConfig, spectrogram_table
from millrace.operators.features import window_arrays
from millrace.schema import DEFAULT, ChannelSchema, require


def padded_column(audio: Column, size: int) -> Column:
    return F.concat(audio, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(size) - F.size(audio))))


def frames_column(audio: Column, size: int, hop: int) -> Column:
    """An array of whole frames."""
    if size <= 0 or hop <= 0:
        raise ValueError("frame and hop sizes must be positive.")
    last = F.size(audio) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(audio, s + 1, F.lit(size)))


def with_spectrogram(arrays: DataFrame, config: SpectrogramConfig = SpectrogramConfig()) -> DataFrame:  # noqa: B008
    """arrays with `spectrogram` (frequency by time) in place of `audio`."""
    kept = [c for c in arrays.columns if c != "audio"]
    schema = StructType([*[arrays.schema[c] for c in kept], StructField("spectrogram", ArrayType(ArrayType(DoubleType())))])

    places, audio = [arrays.columns.index(c) for c in kept], arrays.columns.index("audio")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(audio)
            sizes = np.array([n or 0 for n in column.value_lengths().to_pylist()], dtype=np.int64)
            made = spectrogram_table(column.flatten().to_numpy(zero_copy_only=False).astype(float), sizes, config)
            bins = config.frame_size // 2 + 1
            frames = np.array([len(s) // bins for s in made], dtype=np.int64)
            inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *np.repeat(frames, bins)]), type=pa.int32()), pa.array(np.concatenate([*made, np.zeros(0)])))
            outer = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * bins, type=pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], outer], names=[*kept, "spectrogram"])

    return arrays.mapInArrow(run, schema)


def labeled_spectrograms(signals: DataFrame, labeled: DataFrame, config: SpectrogramConfig = SpectrogramConfig(), schema: ChannelSchema = DEFAULT) -> DataFrame:  # noqa: B008
    """run_name, detection_time, spectrogram and label of labelled windows, ignored ones included; runs stay apart."""
    require(labeled, {"run_name", "detection_time", "start_index", "end_index", "label"}, "columns")
    windows = labeled.select("run_name", "detection_time", "start_index", "end_index", "label")
    return with_spectrogram(window_arrays(signals, windows, schema), config).select("run_name", "detection_time", "spectrogram", "label")
