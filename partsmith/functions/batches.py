"""Steps over Arrow batches. Steps that follow one another run in one pass of the Python workers: only the last one's batches return to Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

Step = Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]


def _through(steps: tuple[Step, ...], batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for b in batches:
        if len(steps) == 1:
            yield from steps[0](b)
        else:
            yield from _through(steps[1:], steps[0](b))


def mapped(df: DataFrame, step: Step, schema: str) -> DataFrame:
    """``step`` on each batch of the table, after the steps that made it, if it comes from here as it is."""
    first, steps = getattr(df, "_batch_steps", (df, ()))
    steps = (*steps, step)
    out = first.mapInArrow(lambda batches: _through(steps, batches), schema)
    out._batch_steps = (first, steps)
    return out
