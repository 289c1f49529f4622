"""A small convolutional scorer of spectrograms; it needs the optional torch package."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


@dataclass(frozen=True)
class CNNConfig:
    in_channels: int = 1
    base_channels: int = 8
    n_classes: int = 2
    dropout: float = 0.1

    def check(self) -> None:
        if min(self.in_channels, self.base_channels, self.n_classes) <= 0:
            raise ValueError("channels and classes must be positive.")
        if not 0 <= self.dropout < 1:
            raise ValueError("A dropout share lies in [0, 1).")


def require_torch() -> None:
    if find_spec("torch") is None:
        raise ImportError("The spectrogram network needs torch.")


def build(config: CNNConfig = CNNConfig()):  # noqa: B008
    """Three blocks of 3x3 convolution, batch norm and ReLU, pooling after the first two, then a linear layer."""
    config.check()
    require_torch()
    from torch import nn

    layers, width = [], config.in_channels
    for i in range(3):
        out = config.base_channels * 2**i
        layers += [nn.Conv2d(width, out, kernel_size=3, padding=1), nn.BatchNorm2d(out), nn.ReLU()]
        layers += [nn.MaxPool2d(2)] if i < 2 else [nn.AdaptiveAvgPool2d(1), nn.Flatten(), nn.Dropout(config.dropout), nn.Linear(out, config.n_classes)]
        width = out
    return nn.Sequential(*layers)


def trainable_parameters(model) -> int:
    return sum(p.numel() for p in model.parameters() if p.requires_grad)


def score_spectrograms(table: DataFrame, weights: dict, config: CNNConfig = CNNConfig()) -> DataFrame:  # noqa: B008
    """table with score; the network is rebuilt once per task from its weights."""
    require_torch()
    schema = StructType([*table.schema.fields, StructField("score", DoubleType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import torch

        model = build(config)
        model.load_state_dict(weights)
        model.eval()
        for part in parts:
            scores = []
            for one in part["spectrogram"]:
                x = torch.tensor(np.stack([np.asarray(r) for r in one]), dtype=torch.float32)[None, None]
                with torch.no_grad():
                    scores.append(float(torch.softmax(model(x), dim=1)[0, 1]))
            yield part.assign(score=scores)

    return table.mapInPandas(run, schema)
