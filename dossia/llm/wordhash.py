"""Hashes of words and runs of words of many texts at once, and a fixed-size table of how common runs are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.llm.common import give_back

SLOTS = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LONG = 48  # bytes; longer words are hashed one at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of texts given as bytes: in ``data`` from ``start`` to ``end``, of text ``text``."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
        step = np.diff(inside)
        self.start, self.end = (np.flatnonzero(step == d).astype(np.int32) for d in (1, -1))
        self.ends_of_texts = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.text = np.searchsorted(self.ends_of_texts, self.start, side="right").astype(np.int32)
        self.count = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count  # the number of each text's first word
        self.hash = self._hashes(raw)

    def _hashes(self, raw: np.ndarray) -> np.ndarray:
        size = self.end - self.start
        out = size.astype(np.uint64)
        active = np.flatnonzero(size <= _LONG)
        k = 0
        while len(active):
            out[active] = out[active] * _ODD + raw[self.start[active] + k]
            k += 1
            active = active[size[active] > k]
        for n in np.flatnonzero(size > _LONG).tolist():
            out[n] = xxhash.xxh64_intdigest(self.data[self.start[n] : self.end[n]])
        return mix(out)


def runs(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words, by the number of its first word (runs may cross from text to text)."""
    out = np.full(max(0, len(hashes) - size + 1), salt, dtype=np.uint64)
    for k in range(size):
        out = out * _ODD + hashes[k : k + len(out)]
    return mix(out)


def by_bytes(column: pa.Array, most: int) -> Iterator[tuple[slice, list[bytes]]]:
    """Runs of rows of about ``most`` bytes, with their texts as bytes (null: empty). Only one run's texts are held beside the column."""
    column = column.cast(pa.binary())
    ends = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64))
    start = 0
    while start < len(ends):
        done = int(ends[start - 1]) if start else 0
        stop = min(int(np.searchsorted(ends, done + most)) + 1, len(ends))
        yield slice(start, stop), [t or b"" for t in column.slice(start, stop - start).to_pylist()]
        start = stop
    give_back()


def slot(hashes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The slot of each hash by its highest bits; ``slots`` is a power of two."""
    return (hashes >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def commonness(texts: DataFrame, hashes_of: Callable[[list[bytes]], np.ndarray], block: int) -> np.ndarray:
    """For each of SLOTS hash slots how common the runs of words in it are over all texts: 0 for up to twice the mean, then 1 more for each doubling.

    ``texts``: one text column; ``hashes_of``: texts to hashes. Each task sends at most SLOTS sums, and the driver gets as many.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for _, part in by_bytes(batch.column(0), block):
                total += np.bincount(slot(hashes_of(part)), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    sums: pd.DataFrame = texts.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(SLOTS)
    n[sums["slot"].to_numpy(dtype=np.int64)] = sums["n"]
    return np.clip(np.floor(np.log2(np.maximum(n, 1) / max(n.mean(), 1.0))), 0, 30).astype(np.uint8)


def rare_first(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A total order of hashes: rare runs of words before common ones, else by hash."""
    return (common[slot(hashes, len(common))].astype(np.uint64) << np.uint64(58)) | (mix(hashes ^ _ODD) >> np.uint64(6))
