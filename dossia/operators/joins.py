"""Joins whose side is broadcast only if it was counted: Spark's guesses of exploded and checkpointed rows are far too low."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Narrow rows that are broadcast at most.
BROADCAST_ROWS = 50_000


def met(large: DataFrame, small: DataFrame, on: str | list[str] | Column) -> DataFrame:
    """The inner join of large and small; small, which is computed once more to be counted, is broadcast if it has few rows, else both are shuffled."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return large.join(F.broadcast(small) if few else small.hint("merge"), on)
