"""Substring deduplication: words that lie in a window of words which also starts earlier are removed.

Windows are brought together by super-k-mer partitioning. A window's minimiser is its rarest run of GRAM words (by a fixed-size table
of how common runs are, ties by hash); consecutive windows that share a minimiser travel as one packed string to the
minimiser's bucket. There all windows are cut out again and sorted, so that equal ones meet exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossia.llm.common import give_back
from dossia.llm.wordhash import Words, by_bytes, commonness, mix, rare_first, runs

WINDOW = 20
GRAM = 3
#: Bytes of text that a task handles at once, and of text per bucket (its windows' packed strings hold about three times as many).
BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 3_000_000

_LAST = np.iinfo(np.int64).max
_FLAGS = "_id long, _key long, first array<int>, last array<int>"
_PACKETS = "bucket int, head binary, packed binary, head_size long, packed_size long"


def _smallest(order: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    out, have = order, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out


def _window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return runs(words, window, 1), runs(words, window, 2)


def later(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether an equal window among these has a smaller (id, start)."""
    out = np.zeros(len(h1), dtype=bool)
    if not len(h1):
        return out
    order = np.argsort(h1, kind="stable")
    same = h1[order[1:]] == h1[order[:-1]]
    if not np.array_equal(same, same & (h2[order[1:]] == h2[order[:-1]])):  # different windows with one hash
        order = np.lexsort((h2, h1))
        same = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
    met = np.zeros(len(h1), dtype=bool)  # in sorted order: has an equal one
    met[1:] |= same
    met[:-1] |= same
    at = order[met]
    if not len(at):
        return out
    head = np.concatenate([[True], ~same])[met]
    group = np.flatnonzero(head)
    least = np.minimum.reduceat(ids[at], group)
    of = np.cumsum(head) - 1
    first = np.minimum.reduceat(np.where(ids[at] == least[of], starts[at], _LAST), group)
    out[at] = (ids[at] > least[of]) | (starts[at] > first[of])
    return out


def _ranges(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts in one row: row, first, last. Rows and starts are sorted."""
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)])
    at = np.flatnonzero(new)
    return rows[at], starts[at], starts[np.concatenate([at[1:] - 1, [len(starts) - 1]])]


def _flag_batch(ids: np.ndarray, keys: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """One row of _FLAGS for each row that has flagged windows."""
    order = np.lexsort((starts, rows))
    row, first, last = _ranges(rows[order], starts[order]) if len(order) else (rows, starts, starts)
    named, count = np.unique(row, return_counts=True)
    offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (first, last)]
    return pa.RecordBatch.from_arrays([pa.array(ids[named]), pa.array(keys[named]), *lists], names=["_id", "_key", "first", "last"])


class _Block:
    """The windows of a block of rows, without those that an earlier window of the block already repeats."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, texts: list[bytes], window: int, common: np.ndarray):
        # Rows that repeat an id and its text have the same windows: one stands for all.
        pairs = np.rec.fromarrays([ids, keys])
        once = np.sort(np.unique(pairs, return_index=True)[1])
        self.ids, self.keys = ids[once], keys[once]
        w = self.words = Words([texts[n] for n in once])
        h1, h2 = _window_hashes(w.hash, window)
        at = np.flatnonzero(w.text[: len(h1)] == w.text[window - 1 :]) if len(h1) else np.zeros(0, np.int64)
        self.start = at - w.first[w.text[at]]
        repeated = later(h1[at], h2[at], self.ids[w.text[at]], self.start)
        self.flagged = at[repeated]
        self.at = at[~repeated]
        self.start = self.start[~repeated]
        gram = min(GRAM, window)
        order = _smallest(rare_first(runs(w.hash, gram, 3), common), window - gram + 1) if len(h1) else np.zeros(0, np.uint64)
        self.minimiser = order[self.at]

    def packets(self, window: int, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
        """bucket, head (rows and starts of the super-k-mers), and their words as one string."""
        w, at, mini = self.words, self.at, self.minimiser
        if not len(at):
            return
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (mini[1:] != mini[:-1]) | (w.text[at[1:]] != w.text[at[:-1]])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(at)]]) - 1
        bucket = (mix(mini[first]) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, first, last = bucket[order], first[order], last[order]
        row, start = w.text[at[first]], self.start[first]
        a, b = w.start[at[first]].tolist(), w.end[at[last] + window - 1].tolist()
        cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
            named, which = np.unique(row[lo:hi], return_inverse=True)
            packed = [w.data[x:y] for x, y in zip(a[lo:hi], b[lo:hi], strict=True)]
            size = np.fromiter(map(len, packed), np.int64, len(packed))
            head = [np.array([len(named), hi - lo]), np.diff(self.ids[named], prepend=0), self.keys[named], np.diff(which, prepend=0), start[lo:hi], size]
            yield int(bucket[lo]), b"".join(x.astype("<i8").tobytes() for x in head), b"".join(packed)


def _repeats_of_bucket(packets: Iterable[tuple[bytes, bytes]], window: int) -> pa.RecordBatch:
    """Flags of the packets' repeated windows; packets are read one after another, so that only one is held beside its words."""
    ids, keys, which, start, texts, base = [], [], [], [], [], 0
    for head, packed in packets:
        x = np.frombuffer(head, dtype="<i8")
        rows, n = int(x[0]), int(x[1])
        i, k, of, s, size = np.split(x[2:], np.cumsum([rows, rows, n, n]))
        ids.append(np.cumsum(i))
        keys.append(k)
        which.append(np.cumsum(of) + base)
        start.append(s)
        ends = np.cumsum(size)
        texts.extend(packed[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True))
        base += rows
    ids, keys, which, start = (np.concatenate(x) for x in (ids, keys, which, start))
    w = Words(texts)
    del texts
    h1, h2 = _window_hashes(w.hash, window)
    at = np.flatnonzero(w.text[: len(h1)] == w.text[window - 1 :])
    text = w.text[at]
    row, begin = which[text], start[text] + at - w.first[text]
    h1, h2 = h1[at], h2[at]
    del w, at, text
    flagged = later(h1, h2, ids[row], begin)
    return _flag_batch(ids, keys, row[flagged], begin[flagged])


def repeated_windows(rows: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """_id, _key, first, last: ranges of starts (in words, from 0) of windows of which an equal one starts earlier, over several rows of a text.

    rows: _id long (order of documents), _key long (hash of the text), text.
    """
    sc = rows.sparkSession.sparkContext
    gram = min(GRAM, window)
    common = sc.broadcast(commonness(rows.select("text"), lambda texts: runs(Words(texts).hash, gram, 3), BLOCK_BYTES))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))

    packet_types = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    flag_types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd", 3)
        names = ["bucket", "head", "packed", "head_size", "packed_size", "_id", "_key", "first", "last"]
        for batch in batches:
            ids, keys = (np.asarray(batch.column(c)) for c in ("_id", "_key"))
            for part, texts in by_bytes(batch.column("text"), BLOCK_BYTES):
                block = _Block(ids[part], keys[part], texts, window, common.value)
                w = block.words
                # What the block finds out itself goes along with the packets.
                flags = _flag_batch(block.ids, block.keys, w.text[block.flagged], block.flagged - w.first[w.text[block.flagged]])
                if flags.num_rows:
                    to = np.asarray(flags["_key"]).view(np.uint64) % np.uint64(buckets)
                    none = [pa.nulls(flags.num_rows, t) for t in packet_types[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *none, *flags.columns], names=names)
                sent = [(b, zstd.compress(h, asbytes=True), zstd.compress(p, asbytes=True), len(h), len(p)) for b, h, p in block.packets(window, buckets)]
                if sent:
                    columns = [pa.array(c, t) for c, t in zip(zip(*sent, strict=True), packet_types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(sent), t) for t in flag_types)], names=names)

    def gather(group: pa.Table) -> pa.Table:
        zstd = pa.Codec("zstd")
        is_packet = group["head"].is_valid()
        found = [group.filter(pc.invert(is_packet)).select(["_id", "_key", "first", "last"])]
        packed = group.filter(is_packet).select(["head", "packed", "head_size", "packed_size"])
        del group
        if packed.num_rows:
            packets = ((zstd.decompress(h.as_buffer(), n.as_py(), asbytes=True), zstd.decompress(p.as_buffer(), m.as_py(), asbytes=True)) for h, p, n, m in zip(*packed.columns, strict=True))
            found.append(pa.Table.from_batches([_repeats_of_bucket(packets, window)]))
        give_back()
        return pa.concat_tables(found)

    return rows.mapInArrow(scatter, f"{_PACKETS}, {_FLAGS}").groupBy("bucket").applyInArrow(gather, _FLAGS)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with kept_text (the words that stay, joined by one space), n_words and n_removed.

    A word is removed if a window of ``window`` consecutive words of its document covers it whose words, in order and unchanged, also
    start earlier: in a document with a smaller id, or in the same one at an earlier start. Windows are judged on the input.
    Null texts have no words. Rows without an id come last, as one document; rows that share an id count as one document at its starts, so
    repeated rows don't remove each other. Columns named as the results are replaced, the others stay.
    """
    kept = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = (F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST))).alias("_id"), F.xxhash64(text).alias("_key"))
    flags = repeated_windows(docs.select(*name, text.alias("text")), window, bucket_bytes)
    flags = flags.groupBy("_id", "_key").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last"))
    rows = docs.select(row.alias("_row"), *name)
    joined = rows.join(flags.hint("shuffle_hash"), ["_id", "_key"], "left").select("_row", "first", "last")
    text_at = kept.index(text_col)
    schema = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), *T.StructType.fromDDL("kept_text string, n_words long, n_removed long").fields])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, count, gone = [], [], []
            of = (batch.column("_row").field(text_at), batch.column("first"), batch.column("last"))
            for text, first, last in zip(*(c.to_pylist() for c in of), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes.split() cuts at these six bytes alone
                n = len(words)
                if first:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, np.asarray(last) + window, -1)
                    stays = np.cumsum(edge[:n]) == 0
                    words = [words[k] for k in np.flatnonzero(stays).tolist()]
                texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                count.append(n)
                gone.append(n - len(words))
            columns = [batch.column("_row"), pa.array(texts, pa.string()), pa.array(count, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "kept_text", "n_words", "n_removed"])
        give_back()

    return joined.mapInArrow(remove, schema).select("_row.*", "kept_text", "n_words", "n_removed")
