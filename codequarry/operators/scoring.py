"""Batch scoring: a model applied to text or vectors on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[pd.Series], Sequence[Any]]


def score_batches(
    df: DataFrame,
    factory: Callable[[], Model],
    in_col: str,
    out_schema: str,
    batch_size: int = 256,
    keep: Sequence[str] = ("id",),
) -> DataFrame:
    """Apply a model to ``in_col`` in batches of ``batch_size`` rows.

    ``factory`` loads the model, once per task, on the executor. The ``keep``
    columns travel with their rows, so results never rely on position.
    ``out_schema`` is ``"name type"``, for example ``"vec array<float>"``.
    """
    out_col = out_schema.split()[0]
    kept = list(keep)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                if model is None:
                    model = factory()
                result = part[kept].copy()
                result[out_col] = list(model(part[in_col]))
                yield result

    columns = list(dict.fromkeys([*kept, in_col]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields]
    return df.select(*columns).mapInPandas(score, ", ".join([*fields, out_schema]))
