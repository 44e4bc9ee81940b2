"""Packing of tokenised documents into sequences of a fixed length by the sum-of-squares rule.

Each piece goes to the open sequence that it fits for which the sum over all residual gaps of the squared number of open
sequences with that gap becomes smallest. A new one is opened when it fits none: as all lengths are known, long pieces come first,
and opening more sequences to keep the sum small would only leave them unfilled.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.llm.bpe import by_block, byte_chars
from dossia.llm.common import give_back, stored

LENGTH = 1024
END_ID = 2
#: Documents whose pieces one task packs: 50,000 pieces leave a few open sequences in tens of thousands.
GROUP_DOCS = 50_000
BLOCK_BYTES = 3_000_000
REMEMBERED = 200_000
#: The pattern by which byte-level BPE cuts a text before merging (a fixed value of the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# A text may be cut before a space unless white space stands on both sides of that space.
_UNSAFE = re.compile(r"\s \s")


class _Remembered(dict):
    """chunk of text (without the space before it): its ids as packed 32-bit integers."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = ids = self.encode(" " + chunk)
        return ids


class ByteBpe:
    """Byte-level BPE of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.known = _Remembered(self._packed)

    def _packed(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text, allowed_special="all"), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as packed unsigned 32-bit integers."""
        if _UNSAFE.search(text):
            return self._packed(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        head, *chunks = text.split(" ")
        return self._packed(head) + b"".join(map(self.known.__getitem__, chunks))


@functools.lru_cache(4)
def model(path: str) -> ByteBpe:
    return ByteBpe(path)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (packed little-endian unsigned 32-bit integers) of each piece of each document.

    A document is its text's ids and then ``end_id``; null and empty texts are ``end_id`` alone. Longer documents are cut so that only
    the first piece may be shorter than ``length``.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = model(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for rows in by_block(np.asarray(pc.binary_length(texts.fill_null(""))), BLOCK_BYTES):
                part, which, number, start, size, data = slice(rows.start, rows.stop), [], [], [], [], []
                for k, text in enumerate(texts[part].to_pylist(), rows.start):
                    packed = bpe.encode(text or "") + end
                    n = len(packed) // 4
                    first = n % length or length
                    for p, to in enumerate(range(first, n + 1, length)):
                        at = max(0, to - length) if p else 0
                        which.append(k)
                        number.append(p)
                        start.append(at)
                        size.append(to - at)
                        data.append(packed[4 * at : 4 * to])
                columns = [ids.take(pa.array(which)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])
        give_back()

    schema = f"doc_id {kind}, piece int, start long, length long, ids binary"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut_up, schema)


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece (in the order given) the number of its sequence and its offset there."""
    open_with = np.zeros(length + 1, dtype=np.int64)  # number of open sequences by residual gap
    waiting: list[list[int]] = [[] for _ in range(length + 1)]
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    used, never = 0, np.iinfo(np.int64).max
    for n, s in enumerate(sizes.tolist()):
        fits = open_with[s:length]  # by the gap that will be left, from 0 to length - s - 1
        if fits.any():
            # Growth of the sum: -2N(g) + 1 for the gap that goes, 2N(g - s) + 1 for the one that comes; a full sequence isn't open.
            growth = 2 * (open_with[: length - s] - fits) + 2
            growth[0] = 1 - 2 * fits[0]
            left = int(np.where(fits > 0, growth, never).argmin())  # of equal ones the smallest gap
            at, filled = waiting[left + s].pop(), length - left - s
            open_with[left + s] -= 1
        else:
            at, filled, left = used, 0, length - s
            used += 1
        if left:
            waiting[left].append(at)
            open_with[left] += 1
        sequence[n], offset[n] = at, filled
    return sequence, offset


def pack(parts: DataFrame, length: int = LENGTH, groups: int = 1, size_col: str = "length") -> DataFrame:
    """parts with sequence_id and offset; sizes from 1 to ``length``.

    Full pieces are sequences of their own and aren't moved. The others are dealt to ``groups`` by a hash of the whole row and its copy
    number there, so that no id or size fills a group, and each group is packed by the sum-of-squares rule, long pieces first.
    Columns named sequence_id or offset are replaced. The columns travel with the pieces: leave out what isn't needed.
    """
    parts = stored(parts.drop("sequence_id", "offset"), "pieces")  # read twice below, made once
    full = parts.where(F.col(size_col) == length).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = parts.where(F.col(size_col) < length)
    whole = F.struct(*[F.col(f"`{c}`") for c in parts.columns])
    # Repeated rows differ by their place in the input, so they spread too.
    rest = rest.withColumn("_group", F.pmod(F.xxhash64(whole, F.monotonically_increasing_id()), F.lit(groups)))
    schema = parts.schema.add("sequence_id", "long").add("offset", "long")

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_group").sort_values([size_col, *(c for c in rows.columns if c in ("doc_id", "piece"))], ascending=False, kind="stable")
        sequence, offset = sum_of_squares(rows[size_col].to_numpy(), length)
        return rows.assign(sequence_id=(int(key[0]) << 40) + sequence, offset=offset)

    return full.unionByName(rest.groupBy("_group").applyInPandas(place, schema))


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their ids, ids_crc32, sequence_id and offset (see ``pieces`` and ``pack``).

    Only places are packed; ids are joined to them afterwards by the number of their stored piece, so no task gathers a group's ids. With
    ``keep_ids=False`` the ids stay behind after their checksum is taken. Repeated rows are packed each; an empty table gives an empty result.
    """
    cut_up = pieces(docs, path, length, end_id).withColumn("ids_crc32", F.crc32("ids"))
    groups = max(1, -(-docs.count() // group_docs))
    if not keep_ids:
        return pack(cut_up.drop("ids"), length, groups)
    numbered = stored(cut_up.withColumn("_number", F.monotonically_increasing_id()), "tokens")  # the stored number doesn't change any more
    places = pack(numbered.drop("ids"), length, groups).select("_number", "sequence_id", "offset")
    return numbered.join(places, "_number").drop("_number")
