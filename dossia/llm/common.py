"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.operators.checkpoints import cut, shared_dir

#: Rows up to which a side with a few fixed-width columns is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

__all__ = ["BROADCAST_ROWS", "ascii_lower", "cut", "draw_below", "drawn", "give_back", "read", "shared_dir", "small", "stored"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: columns can then be read on their own."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns freed memory to the system. Python workers live through all stages, and what a task once took would stay theirs beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (give a checkpointed frame of narrow rows), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    """A-Z only. For texts of ASCII alone lower() does the same and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def draw_below(want: int, rows: int) -> int:
    """The 64-bit hash up to which a row belongs to a sample of about ``want`` of ``rows`` rows. All 64 bits count, so no share rounds to
    nothing however many the rows; with want >= rows all are drawn."""
    return 2**63 - 1 if want >= rows else -(2**63) + (max(0, want) << 64) // rows


def drawn(hashed: Column, want: int, rows: int) -> Column:
    """Whether a row with this 64-bit hash belongs to a sample of about ``want`` of ``rows`` rows."""
    return hashed <= F.lit(draw_below(want, rows))
