"""Models that users bring: a vectorised batch function with one set-up for each worker."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class BatchModel(ABC):
    """Recognises batches of inputs; made once in each Python worker."""

    @abstractmethod
    def predict(self, batch: pd.Series) -> pd.Series:
        """One result for each input, in order."""


def apply_model(make: Callable[[], BatchModel], column: Column, kind: str = "string") -> Column:
    """The model's results as a column: inputs come in Arrow batches, never row by row."""
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            out = model.predict(batch)
            if len(out) != len(batch):
                raise ValueError("a model returns one result for each input")
            yield out
    return run(column)
