"""Similarity join of documents by the Jaccard similarity of their word shingles, with PartEnum signatures.

The domain of shingles is cut into partitions of two levels; subsets of two of the three parts of each first-level partition are
enumerated, and a set's signature for a subset is its projection onto it. Let two sets of a and b shingles with similarity t
or more differ in at most D elements. One of them spoils two of the subsets of its first-level partition, more spoil three: with n first-level
partitions at most M = min(2 * D, n + D) of a set's signatures differ, so of its signatures in any order that all sets
share the first M + 1 hold one that both have. The order takes signatures of rare shingles first, so that a passage which many
documents hold brings few unrelated ones together. Sets with no more than M signatures that aren't empty also use single
shingles as signatures.

Sets that share a signature and are near in size are candidates. Where more than ``WINDOW`` sets are, they are met again by a second
shared signature: single shingles, rarest first among such sets, at places that leave room for enough common ones. Small
sketches rule out most candidates, and the rest are compared exactly.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.llm.common import cut, give_back, small, stored
from dossia.operators.components import components
from dossia.llm.wordhash import Words, by_bytes, mix, rare_first, runs, slot

SHINGLE = 5
PERCENT = 75
#: Bytes of text that a task handles at once, and of text per bucket of signatures, whose signatures are met in so many parts one after another.
BLOCK_BYTES = 1_500_000
BUCKET_BYTES = 32_000_000
BUCKET_PARTS = 8
#: Hash slots in which all shingles, and those of crowded sets, are counted, to tell rare ones from common ones.
SLOTS = 1 << 21
#: Counts of slots travel in so many pieces, which are added up for so many classes of tasks first and then for all.
PIECES = 256
TASK_CLASSES = 64
#: Numbers of 64 bits in the sketch that the second signatures carry.
SKETCH = 8
#: A set is a candidate of the sets that share a signature and aren't smaller, if so many of them or fewer are near in size; else all of these meet by a second signature.
WINDOW = 16
#: Members that meet the same set are dealt to so many tasks at most.
SALTS = 64

#: A band holds sizes from 4**j to 4**(j + 1), which share one partition of the domain: 4**j first-level partitions of three parts.
BAND = 4
PARTS = 3
SUBSETS = list(combinations(range(PARTS), 2))


def _differ(a: np.ndarray, percent: int) -> np.ndarray:
    """The largest number of elements in which a set of size a and a similar one can differ: (a + b)(100 - percent)/(100 + percent), b <= 100a/percent."""
    return (a + a * 100 // percent) * (100 - percent) // (100 + percent)


class Shingles:
    """The sets of distinct shingles of texts: ``hash`` sorted within each text, ``size`` and ``first`` by text, and a fingerprint of each set."""

    def __init__(self, texts: list[bytes], width: int):
        w = Words([t.lower() for t in texts])  # bytes: A-Z only
        h = runs(w.hash, width)
        at = np.flatnonzero(w.text[: len(h)] == w.text[width - 1 :]) if len(h) else np.zeros(0, np.int64)
        few = np.flatnonzero((w.count > 0) & (w.count < width))
        # Fewer words: the whole sequence is one shingle.
        whole = np.array([_sequence(w.hash[w.first[n] : w.first[n] + w.count[n]]) for n in few.tolist()], dtype=np.uint64)
        self.all = np.concatenate([h[at], whole])
        text = np.concatenate([w.text[at], few])
        order = np.lexsort((self.all, text))
        value, text = self.all[order], text[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        self.hash, self.text = value[new], text[new]
        self.size = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(self.size) - self.size
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hash))])
        self.print = mix(total[self.first + self.size] - total[self.first] + self.size.astype(np.uint64)).view(np.int64)


    def sketches(self) -> list[bytes]:
        """For each text its size in eight bytes, then a power of two of bits, two to four for each shingle: whether an odd number of its shingles falls there."""
        bits = 1 << np.ceil(np.log2(np.maximum(self.size * 2, 64))).astype(np.int64)
        ends = np.cumsum(bits)
        at = (ends - bits)[self.text] + (self.hash & (bits[self.text] - 1).astype(np.uint64)).astype(np.int64)
        odd = np.packbits(np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0).astype(np.uint8) & 1, bitorder="little").tobytes()
        sizes = self.size.astype("<u8").tobytes()
        return [sizes[8 * n : 8 * n + 8] + odd[(e - c) // 8 : e // 8] for n, (c, e) in enumerate(zip(bits.tolist(), ends.tolist(), strict=True))]


def _sequence(hashes: np.ndarray) -> int:
    return int(mix(runs(hashes, len(hashes), 7 + len(hashes)))[0])


def signatures(sets: Shingles, chosen: np.ndarray, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and signature of each signature that the chosen texts need."""
    size = sets.size[chosen]
    band = np.floor(np.log2(np.maximum(size, 1)) / np.log2(BAND)).astype(np.int64)
    band += (BAND ** (band + 1) <= size).astype(np.int64) - (BAND**band > size).astype(np.int64)
    next_too = size * 100 // percent >= BAND ** (band + 1)
    texts, out = [], []
    for b in np.unique(np.concatenate([band, band[next_too] + 1])).tolist():
        members = chosen[(band == b) | (next_too & (band + 1 == b))]
        text, sig = _of_band(sets, members[sets.size[members] > 0], b, percent, common)
        texts.append(text)
        out.append(sig)
    return np.concatenate(texts or [np.zeros(0, np.int64)]), np.concatenate(out or [np.zeros(0, np.uint64)])


def _first(text: np.ndarray, sig: np.ndarray, order: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text (0, 1, ...) the first ``keep[text]`` signatures in order."""
    at = np.lexsort((order, text))
    text, sig = text[at], sig[at]
    start = np.searchsorted(text, text, side="left")
    stays = np.arange(len(text)) - start < keep[text]
    return text[stays], sig[stays]


def _of_band(sets: Shingles, members: np.ndarray, band: int, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(members):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n1 = BAND**band
    size = sets.size[members]
    number = np.repeat(np.arange(len(members)), size)
    at = np.repeat(sets.first[members] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    h = sets.hash[at]
    salt = np.array([band + 1], dtype=np.uint64)
    part = (mix(h + salt * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(n1 * PARTS)).astype(np.int64)
    # Sum of hashes and rarest class of each part of each first-level partition that isn't empty.
    key = number * (n1 * PARTS) + part
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    key, total = key[order][start], np.add.reduceat(mix(h ^ salt)[order], start)
    rarest = np.minimum.reduceat(common[slot(h, len(common))][order], start)
    first, part = np.divmod(key, PARTS)
    group, at = np.unique(first, return_inverse=True)
    sums, least = np.zeros((len(group), PARTS), np.uint64), np.full((len(group), PARTS), 255, np.uint8)
    sums[at, part], least[at, part] = total, rarest
    text = np.concatenate([group // n1] * len(SUBSETS))
    cell = np.concatenate([(group % n1) * len(SUBSETS) + k for k in range(len(SUBSETS))])
    total = np.concatenate([sums[:, s].sum(axis=1, dtype=np.uint64) for s in map(list, SUBSETS)])
    rarest = np.concatenate([least[:, s].min(axis=1) for s in map(list, SUBSETS)])
    full = rarest < 255
    text, cell, total, rarest = text[full], cell[full], total[full], rarest[full]
    sig = mix(total ^ mix(cell.astype(np.uint64) * np.uint64(64) + salt))
    rank = (rarest.astype(np.uint64) << np.uint64(58)) | (sig >> np.uint64(6))
    differ = _differ(size, percent)
    most = np.minimum(2 * differ, n1 + differ)
    text_a, sig_a = _first(text, sig, rank, most + 1)
    # Sets with too few signatures that aren't empty: single shingles too, of which at most a (100 - percent) / 100 differ.
    poor = np.bincount(text, minlength=len(members)) <= most
    single = poor[number]
    text_b, sig_b = _first(number[single], mix(h[single] ^ np.uint64(0x51ED27)), rare_first(h[single], common), size * (100 - percent) // 100 + 1)
    return members[np.concatenate([text_a, text_b])], np.concatenate([sig_a, sig_b])


def _packets(sets: Shingles, percent: int, common: np.ndarray, buckets: int) -> Iterator[tuple]:
    """bucket, fingerprints, sizes and signatures, packed; a set that several texts have is sent once.

    Of each signature 31 bits are sent (sets that meet by chance are few beside a bucket's candidates), and one that marks the first one of a set.
    """
    text, sig = signatures(sets, np.unique(sets.print, return_index=True)[1], percent, common)
    bucket = (sig % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((text, bucket))
    text, bucket, rest = text[order], bucket[order], (sig // np.uint64(buckets))[order].astype("<u4")
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])
    rest = (rest << np.uint32(1)) | new
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo < hi:
            named = text[lo:hi][new[lo:hi]]
            yield int(bucket[lo]), sets.print[named].astype("<i8").tobytes(), sets.size[named].astype("<i4").tobytes(), rest[lo:hi].tobytes()


def _candidates(table: pa.Table, percent: int) -> pa.Table:
    """kind 0: pairs a, b of candidates; kind 1: set a of n shingles, which is to meet others by a second signature."""
    named, number = np.unique(_end_to_end(table["prints"], "<i8"), return_inverse=True)
    size = np.zeros(len(named), np.int64)
    size[number] = _end_to_end(table["sizes"], "<i4")
    sigs = _end_to_end(table["sigs"], "<u4")
    number = number.astype(np.int32)[np.cumsum(sigs & np.uint32(1), dtype=np.int32) - 1]
    sigs = sigs >> np.uint32(1)
    codes, many = [], []
    for part in range(BUCKET_PARTS):
        at = np.flatnonzero(sigs % np.uint32(BUCKET_PARTS) == part)
        if len(at):
            code, crowded = _candidates_of(sigs[at], number[at], size, percent)
            codes.append(np.unique(code))
            many.append(crowded)
    a, b = np.divmod(np.unique(np.concatenate(codes)), len(named))
    many = np.unique(np.concatenate(many))
    give_back()
    return pa.table({
        "kind": np.repeat(np.array([0, 1], np.int32), [len(a), len(many)]), "a": named[np.concatenate([a, many])],
        "b": np.concatenate([named[b], np.zeros(len(many), np.int64)]), "n": np.concatenate([np.zeros(len(a), np.int64), size[many]]),
    })


def _candidates_of(s: np.ndarray, number: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each signature s of set ``number`` the pairs of candidates (smaller number times the number of sets, plus the larger one), and the sets in crowds.

    Of those sets, each is paired with the one of smallest fingerprint that shares the signature too: a family of copies mostly is linked by that.
    """
    order = np.lexsort((number, size[number], s))
    number, s = number[order], s[order]
    once = np.ones(len(s), dtype=bool)
    once[1:] = (s[1:] != s[:-1]) | (number[1:] != number[:-1])
    number, s = number[once].astype(np.int64), s[once]
    n = size[number]
    group = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]))
    # Within a group sizes ascend: those near enough to i end before end[i].
    room = int(n.max()) * 100 // percent + 2
    end = np.searchsorted(group * room + n, group * room + n * 100 // percent, side="right")
    ahead = end - np.arange(len(s)) - 1
    crowded = ahead > WINDOW
    codes = []

    def pair(i: np.ndarray, j: np.ndarray) -> None:
        a, b = number[i], number[j]
        codes.append(np.minimum(a, b) * len(size) + np.maximum(a, b))

    i = np.flatnonzero((ahead > 0) & ~crowded)
    for d in range(1, WINDOW + 1):
        i = i[ahead[i] >= d]
        pair(i, i + d)
    edge = np.bincount(np.flatnonzero(crowded), minlength=len(s) + 1) - np.bincount(end[crowded], minlength=len(s) + 1)
    again = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if len(again):
        first = np.flatnonzero(np.concatenate([[True], np.diff(group[again]) != 0]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(again))))
        least = again[np.lexsort((number[again], group[again]))][first][of]
        near = (100 * np.minimum(n[again], n[least]) >= percent * np.maximum(n[again], n[least])) & (number[again] != number[least])
        pair(again[near], least[near])
    return np.concatenate(codes), number[again]


def _end_to_end(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The values of a binary column without nulls as numbers, one after another."""
    out = []
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk) and ends[-1] > ends[0]:
            out.append(np.frombuffer(chunk.buffers()[2], np.uint8, int(ends[-1] - ends[0]), int(ends[0])))
    return (np.concatenate(out) if out else np.zeros(0, np.uint8)).view(kind)


def _views(column: pa.Array, kind: str) -> Iterator[np.ndarray]:
    """Each value of a binary column without nulls as numbers, without copying it."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    size, data = np.dtype(kind).itemsize, column.buffers()[2]
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield np.frombuffer(data, kind, (b - a) // size, a) if b > a else np.empty(0, kind)


def _classes(times: np.ndarray) -> np.ndarray:
    """How common the shingles of each slot are: two steps for each doubling of their number."""
    return np.minimum(np.floor(2 * np.log2(np.maximum(times, 1))), 63).astype(np.uint8)


def _pieces(times: np.ndarray) -> list[bytes]:
    """A task's counts in PIECES pieces: bytes, or four bytes each where one doesn't hold them."""
    return [(p.astype("<u1") if p.max() < 256 else p.astype("<u4")).tobytes() for p in np.split(times, PIECES)]


def _added(table: pa.Table) -> pa.Table:
    """The sum of pieces of one number; a sum is held in eight bytes a slot, which its length tells."""
    size, total = SLOTS // PIECES, np.zeros(SLOTS // PIECES, dtype=np.int64)
    for value in table["counts"].to_pylist():
        total += np.frombuffer(value, f"<u{len(value) // size}").astype(np.int64)
    return table.slice(0, 1).set_column(table.column_names.index("counts"), "counts", pa.array([total.astype("<u8").tobytes()]))


def _collected(pieces: DataFrame) -> np.ndarray:
    """Sums of the tasks' pieces (piece, task, counts): SLOTS numbers."""
    for keys in (["piece", "task"], ["piece"]):
        pieces = pieces.groupBy(*keys).applyInArrow(_added, "piece int, task int, counts binary")
    times = np.zeros(SLOTS, dtype=np.int64)
    for row in pieces.select("piece", "counts").collect():  # PIECES rows of a fixed size
        size = SLOTS // PIECES
        times[row.piece * size : (row.piece + 1) * size] = np.frombuffer(row.counts, "<u8")
    return times


def _task_class() -> int:
    return TaskContext.get().partitionId() % TASK_CLASSES


def _survey(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Size, fingerprint and sketch of each row's set; then pieces of how often each hash slot is met, with the number of the piece and a class of tasks."""
    names = ["_id", "_key", "print", "n", "sketch", "piece"]
    times = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        for part, texts in by_bytes(batch.column("text"), BLOCK_BYTES):
            s = Shingles(texts, width)
            times += np.bincount(slot(s.all, SLOTS), minlength=SLOTS)
            size = part.stop - part.start
            own = [batch.column(c).slice(part.start, size) for c in ("_id", "_key")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(s.print), pa.array(s.size.astype(np.int64)), pa.array(s.sketches(), pa.binary()), pa.nulls(size, pa.int32())], names=names)
    none = pa.nulls(PIECES, pa.int64())
    task = pa.array(np.full(PIECES, _task_class(), np.int64))
    yield pa.RecordBatch.from_arrays([none, none, none, task, pa.array(_pieces(times), pa.binary()), pa.array(np.arange(PIECES, dtype=np.int32))], names=names)


def _meeting(pairs: DataFrame, data: DataFrame) -> DataFrame:
    """For each a its value (b is null), then the values of the b that it meets, next to each other in one task.

    data: print, value, one row for each print. An a that meets many is copied to SALTS tasks at most, and its pairs are dealt to them.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")
    pairs = pairs.select("a", "b", salt)
    firsts = pairs.select("a", "salt").distinct().join(data, F.col("a") == F.col("print")).select("a", "salt", F.lit(None).cast("long").alias("b"), "value")
    others = pairs.join(data, F.col("b") == F.col("print")).select("a", "salt", "b", "value")
    return firsts.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b")).select("a", "b", "value")


def _met(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[pa.RecordBatch, list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    """Of each batch of ``_meeting`` the rows that are pairs, with both values as numbers."""
    first = np.empty(0, kind)
    for batch in batches:
        at, values = [], []
        for k, (b, value) in enumerate(zip(batch.column("b").to_pylist(), _views(batch.column("value"), kind), strict=True)):
            if b is None:
                first = value.copy()
            else:
                at.append(k)
                values.append((first, value))
        yield batch.select(["a", "b"]).take(pa.array(at, pa.int32())), values


def _not_ruled_out(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that may be similar. Values are sketches: sets differ in at least as many elements as their sketches in bits; the larger sketch is folded onto the smaller one."""
    for pairs, values in _met(batches, "<u8"):
        keep = []
        for x, y in values:
            bits = min(len(x), len(y)) - 1
            p, q = (np.bitwise_xor.reduce(z[1:].reshape(-1, bits), axis=0) for z in (x, y))
            keep.append(int(np.bitwise_count(p ^ q).sum()) <= int(x[0] + y[0]) * (100 - percent) // (100 + percent))
        yield pairs.filter(pa.array(keep, pa.bool_()))
    give_back()


def _compare(batches: Iterator[pa.RecordBatch], percent: int, bits: int) -> Iterator[pa.RecordBatch]:
    """a, b, link of each pair. With 32 of the hashes' 64 bits, link is null where their chance meetings might decide."""
    for pairs, values in _met(batches, "<u8" if bits == 64 else "<u4"):
        links = []
        for x, y in values:
            shared = len(np.intersect1d(x, y, assume_unique=bits == 64))
            spare = 0 if bits == 64 else 3 + -(-8 * len(x) * len(y) // 2**32)
            enough = [100 * k >= percent * (len(x) + len(y) - k) for k in (shared - spare, shared + spare)]
            links.append(enough[0] if enough[0] == enough[1] else None)
        yield pa.RecordBatch.from_arrays([*pairs.columns, pa.array(links, pa.bool_())], names=["a", "b", "link"])
    give_back()


class _Corpus:
    """A table's rows (_id, _key, text) and what is known of their sets."""

    def __init__(self, rows: DataFrame, width: int, percent: int):
        self.rows, self.width, self.percent = rows, width, percent
        seen = stored(rows.mapInArrow(lambda batches: _survey(batches, width), "_id long, _key long, print long, n long, sketch binary, piece int"), "shingles")
        self.sets = seen.where("piece is null").select("_id", "_key", "print", "n", "sketch")
        self.common = rows.sparkSession.sparkContext.broadcast(_classes(_collected(seen.where("piece is not null").select("piece", F.col("n").cast("int").alias("task"), F.col("sketch").alias("counts")))))
        # One row of the table for each set that isn't empty, how many rows have it, and their least id.
        one = self.sets.where("n > 0").groupBy("print").agg(F.min(F.struct("_id", "_key", "n", "sketch")).alias("row"), F.count("*").alias("times"), F.min("_id").alias("least"))
        self.one = stored(one.select("print", "row.*", "times", "least"), "sets")

    def candidates(self, buckets: int) -> DataFrame:
        width, percent, common = self.width, self.percent, self.common

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, texts in by_bytes(batch.column("text"), BLOCK_BYTES):
                    sent = list(_packets(Shingles(texts, width), percent, common.value, buckets))
                    if sent:
                        types = [pa.int32(), *[pa.binary()] * 3]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*sent, strict=True), types, strict=True)], names=["bucket", "prints", "sizes", "sigs"])

        packets = self.rows.select("text").mapInArrow(send, "bucket int, prints binary, sizes binary, sigs binary")
        return stored(packets.groupBy("bucket").applyInArrow(lambda t: _candidates(t, percent), "kind int, a long, b long, n long"), "candidates")

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches don't rule out that they are similar; checkpointed. Sketches are a small part of the sets."""
        percent = self.percent
        met = _meeting(pairs, self.one.select("print", F.col("sketch").alias("value")))
        return cut(met.mapInArrow(lambda batches: _not_ruled_out(batches, percent), "a long, b long"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of different sets that are similar; checkpointed. Half of each hash decides nearly all, the whole hashes the rest."""
        judged = self._judged(pairs, 32)
        unsure = cut(judged.where("link is null").select("a", "b"))
        links = judged.where("link").select("a", "b")
        if unsure.isEmpty():
            return links
        return cut(links.unionByName(self._judged(unsure, 64).where("link").select("a", "b")))

    def _judged(self, pairs: DataFrame, bits: int) -> DataFrame:
        percent = self.percent
        wanted = pairs.select(F.col("a").alias("print")).unionByName(pairs.select(F.col("b").alias("print"))).distinct()
        met = _meeting(pairs, self._whole(wanted, bits))
        return cut(met.mapInArrow(lambda batches: _compare(batches, percent, bits), "a long, b long, link boolean"))

    def _whole(self, wanted: DataFrame, bits: int) -> DataFrame:
        """print and value (the sorted hashes, or their upper halves) of the sets wanted, read again from one row each."""
        width = self.width
        one = small(cut(self.one.join(wanted, "print", "left_semi").select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), F.col("print").alias("_p"))))
        rows = self.rows.join(one, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i"))).select("_p", "text")
        # A row that the table repeats gives its set once.
        rows = rows.dropDuplicates(["_p"]) if self.repeats else rows

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in by_bytes(batch.column("text"), BLOCK_BYTES):
                    s = Shingles(texts, width)
                    h = s.hash.astype("<u8") if bits == 64 else (s.hash >> np.uint64(32)).astype("<u4")
                    packed = [h[f : f + n].tobytes() for f, n in zip(s.first.tolist(), s.size.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("_p").slice(part.start, part.stop - part.start), pa.array(packed, pa.binary())], names=["print", "value"])

        return rows.mapInArrow(read, "print long, value binary")

    @functools.cached_property
    def repeats(self) -> bool:
        """Whether some row's id and text are met again."""
        return not self.sets.where("n > 0").groupBy("_id", "_key").agg(F.count("*").alias("times")).where("times > 1").isEmpty()

    def second(self, many: DataFrame) -> DataFrame:
        """Pairs of sets of ``many`` (print, n, component) that aren't in one component and have a rare shingle in common; not yet compared.

        Similar sets share at least s = percent * (n + m) / (100 + percent) shingles, so the first one that they share, in an order common to all, has
        at least s - 1 after it in both: it's among the first n * (100 - percent) / 100 + 1. Shingles that few of these sets have come first.
        """
        percent = self.percent
        held = stored(self._whole(many.select("print"), 64).join(many, "print"), "crowded")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            times = np.zeros(SLOTS, dtype=np.int64)
            for batch in batches:
                for h in _views(batch.column("value"), "<u8"):
                    times += np.bincount(slot(h, SLOTS), minlength=SLOTS)
            columns = [pa.array(np.arange(PIECES, dtype=np.int32)), pa.array(np.full(PIECES, _task_class(), np.int32)), pa.array(_pieces(times), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "task", "counts"])

        times = _collected(held.select("value").mapInArrow(count, "piece int, task int, counts binary"))
        common = held.sparkSession.sparkContext.broadcast(_classes(times))
        words = [f"s{k}" for k in range(SKETCH)]

        def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shingles, odd = [], []
                for h in _views(batch.column("value"), "<u8"):
                    shingles.append(h[np.argsort(rare_first(h, common.value))][: len(h) * (100 - percent) // 100 + 1].view(np.int64))
                    cells = np.bincount((h & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH)
                    odd.append(np.packbits(cells.astype(np.uint8) & 1, bitorder="little").view("<i8"))
                if shingles:
                    times = [len(h) for h in shingles]
                    own = pa.array(np.repeat(np.arange(len(shingles)), times))
                    place = np.concatenate([np.arange(n) for n in times])
                    sketch = np.repeat(np.array(odd), times, axis=0)
                    columns = [np.concatenate(shingles), *(batch.column(c).take(own) for c in ("print", "n", "component")), place, *sketch.T]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "print", "n", "component", "place", *words])

        firsts = stored(held.mapInArrow(rarest, ", ".join(f"{c} long" for c in ("shingle", "print", "n", "component", "place", *words))), "rarest")
        # Of each shingle's sets, those outside their largest component meet those of other components.
        parts = firsts.groupBy("shingle", "component").agg(F.count("*").alias("size"))
        main = parts.groupBy("shingle").agg(F.max(F.struct("size", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
        members = cut(firsts.join(small(cut(main.select("shingle", "main"))), "shingle"))
        others = members.where("component <> main").select("shingle", *(F.col(c).alias(f"{c}_2") for c in ("print", "n", "component", "place", *words)))
        each_once = (F.col("component") == F.col("main")) | (F.col("print") < F.col("print_2"))
        both = F.col("n") + F.col("n_2")
        room = F.least(F.col("n") - F.col("place"), F.col("n_2") - F.col("place_2")) * (100 + percent) >= both * percent
        differ = functools.reduce(operator.add, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_2"))) for w in words])
        similar = room & (differ * (100 + percent) <= both * (100 - percent))
        met = members.join(others, "shingle").where(each_once & similar & (F.col("component") != F.col("component_2")))
        return met.select(F.least("print", "print_2").alias("a"), F.greatest("print", "print_2").alias("b")).distinct()


def _with_component(prints: DataFrame, joined: DataFrame, of: str, name: str) -> DataFrame:
    """prints with the component of the set in column ``of``; a set that nothing has joined is its own."""
    joined = joined.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return prints.join(joined, F.col(of) == F.col("_node"), "left").withColumn(name, F.coalesce("_component", of)).drop("_node", "_component")


def _joined_further(joined: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after further links: components are joined as nodes of a smaller graph."""
    for side in ("a", "b"):
        links = _with_component(links, joined, side, f"of_{side}")
    more = cut(components(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))))
    known = _with_component(joined, more.select("node", "component"), "component", "now").select("node", F.col("now").alias("component"))
    return known.unionByName(more.join(joined.select("node"), "node", "left_anti"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """id, n_shingles, component_id for each row of docs.

    A row's set holds the distinct runs of ``width`` words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) of its whole text; with fewer words the whole sequence;
    without words, or with null text, nothing. Rows link when 100 * |intersection| >= percent * |union|; component_id is the smallest
    id reachable by links, its own included. Empty sets link with nothing. Rows without an id link like others but give no
    component its id: a component of such rows alone has none. Repeated rows, and rows that share an id, are rows like others. Shingles are compared by
    64-bit hashes. Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    corpus = _Corpus(rows, width, percent)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = corpus.candidates(max(1, -(-total // bucket_bytes), min(8, total // BLOCK_BYTES)))
    pairs = cut(found.where("kind = 0").select("a", "b").distinct())
    links = corpus.links(corpus.near(pairs))
    joined = cut(components(links))
    # Then crowded sets meet those that nothing has joined them to.
    many = cut(_with_component(found.where("kind = 1").select(F.col("a").alias("print"), "n").distinct(), joined, "print", "component"))
    if not many.isEmpty():
        again = cut(corpus.second(many).join(pairs, ["a", "b"], "left_anti"))
        joined = cut(_joined_further(joined, corpus.links(corpus.near(again))))
    # The least id of each component, for the sets that more than one row has or something has joined.
    of_set = _with_component(corpus.one.select("print", "times", "least"), joined, "print", "root")
    roots = of_set.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("times").alias("rows")).where("rows > 1")
    known = small(cut(of_set.join(small(cut(roots)), "root").select("print", "component_id", F.lit(True).alias("known"))))
    done = corpus.sets.join(known, "print", "left")
    component = F.when(F.col("known") & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("_id"))
    return done.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose id is the smallest of their component; rows without an id stay. Ids name documents: rows that share one go together.

    Texts without words stay, as do repeated rows of an id that stays; columns of docs come along whatever their names; an empty table gives an empty result.
    """
    found = jaccard_components(docs.select(id_col, text_col), id_col, text_col, width, percent)
    losers = small(cut(found.where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias("id")).distinct()))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    return rows.join(losers, "id", "left_anti").select("row.*")
