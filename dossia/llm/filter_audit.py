"""Audit of how filters overlap and what each removes, in every order of them.

Texts are routed to partitions by their xxhash. A partition keeps a chain of the texts of each fingerprint, with the text in full and the smallest id seen, and
emits the ids that aren't the smallest. Each document then is a mask of the filters that it fails; ``combineByKey`` merges counts by mask,
and all orders are read off those counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.llm.common import cut, small, stored

#: Bytes of texts that a task holds before it sends them on; copies within them are settled where they lie. Partitions get about as many.
BLOCK_BYTES = 32 << 20
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = b"#$%&*|"
_CONTINUES = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that don't start a code point

Row = tuple[int | None, Any, int]  # id, what the row carries, mask


def failed_filters(text: bytes) -> int:
    """Mask of the filters A to D (bit 0 to 3) that a text in UTF-8 fails.

    A: under 50 words; B: distinct words under 65 of 100 words; C: letters A-Z over 5 of 100 code points; D: holds one of ``#$%&*|``.
    Words are runs without the characters 20 and 09 to 0D, case-sensitive.
    """
    words = text.split()  # of bytes: exactly these six characters part words
    points = len(text.translate(None, _CONTINUES))
    mask = len(words) < 50
    mask |= (100 * len(set(words)) < 65 * len(words)) << 1
    mask |= (100 * (len(text) - len(text.translate(None, _UPPER))) > 5 * points) << 2
    mask |= (len(text) != len(text.translate(None, _SIGNS))) << 3
    return int(mask)


def _settle(chains: dict[int, list[list]], key: int, text: bytes, rows: Iterable[Row]) -> Iterator[Row]:
    """Rows of one text enter its chain; those that turn out not to have the smallest id come out, with the bit of copies."""
    chain = chains.setdefault(key, [])
    entry = next((e for e in chain if e[0] == text), None)
    if entry is None:
        chain.append(entry := [text, None, []])
    for row in rows:
        if not entry[2] or row[0] < entry[1]:
            yield from (r[:2] + (r[2] | COPY,) for r in entry[2])
            entry[1], entry[2] = row[0], [row]
        elif row[0] == entry[1]:
            entry[2].append(row)
        else:
            yield row[:2] + (row[2] | COPY,)


def _send(block_bytes: int) -> Callable[[Iterable], Iterator[tuple[int, tuple]]]:
    """Pairs by which rows travel: a fingerprint with its text and the rows of its smallest id so far, or a settled row by a hash of its id."""

    def settled(row: Row) -> tuple[int, tuple]:
        return xxhash.xxh64_intdigest(str(row[0])) >> 1, (None, [row])

    def send(rows: Iterable) -> Iterator[tuple[int, tuple]]:
        chains: dict[int, list[list]] = {}
        held = 0

        def flush() -> Iterator[tuple[int, tuple]]:
            for key, chain in chains.items():
                for text, _, waiting in chain:
                    yield key, (text, waiting)
            chains.clear()

        for doc_id, carried, text in rows:
            text = bytes(text or b"")
            row = (doc_id, carried, failed_filters(text))
            if doc_id is None:  # no smaller id than none
                yield settled(row)
                continue
            yield from map(settled, _settle(chains, xxhash.xxh64_intdigest(text) >> 1, text, [row]))
            held += len(text) + 64
            if held >= block_bytes:
                yield from flush()
                held = 0
        yield from flush()

    return send


def _receive(pairs: Iterable[tuple[int, tuple]]) -> Iterator[Row]:
    chains: dict[int, list[list]] = {}
    for key, (text, rows) in pairs:
        if text is None:
            yield from rows
        else:
            yield from _settle(chains, key, text, rows)
    for chain in chains.values():
        for _, _, rows in chain:
            yield from rows


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, part, mask for each row of docs: which of the filters A to E it fails (bits 0 to 4).

    Null texts count as empty, null parts as the empty string. E: the text is identical to that of any smaller id in the table; rows that repeat an id and its text
    aren't copies of each other, and rows without an id fail E never. Texts of any length are routed whole, each distinct one at most once for each
    block of a task. An empty table gives an empty result; other columns of docs are not read.
    """
    id_type = docs.select(F.col(id_col).alias("doc_id")).schema[0].dataType.simpleString()
    if id_type not in ("tinyint", "smallint", "int", "bigint", "string"):
        raise ValueError(f"ids of type {id_type}")
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    text = F.col(text_col).cast("string").cast("binary").alias("text")
    total, least = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), part.alias("part"), text).rdd
    routed = rows.mapPartitions(_send(block_bytes)).partitionBy(max(least, -(-total // block_bytes)), lambda key: key).mapPartitions(_receive)
    return docs.sparkSession.createDataFrame(routed, f"doc_id {id_type}, part string, mask int")


def mask_counts(masks: RDD) -> RDD:
    """(part, {mask: [rows, of quality 1, toxic]}) from rows (part, mask, good, toxic): at most 32 counts for each part."""

    def merge(counts: dict[int, list[int]], x: tuple[int, int, int]) -> dict[int, list[int]]:
        old = counts.setdefault(x[0], [0, 0, 0])
        old[0] += 1
        old[1] += x[1]
        old[2] += x[2]
        return counts

    def join(a: dict[int, list[int]], b: dict[int, list[int]]) -> dict[int, list[int]]:
        for mask, counts in b.items():
            a[mask] = [p + q for p, q in zip(a.get(mask, (0, 0, 0)), counts, strict=True)]
        return a

    return masks.map(lambda r: (r[0], (r[1], r[2], r[3]))).combineByKey(lambda x: merge({}, x), merge, join)


def audit_orders(counts: dict[int, list[int]], filters: str = FILTERS) -> Iterator[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of every step of every order.

    ``counts``: rows, rows of quality 1 and toxic rows by the mask of failed filters. shapley: the rows that the step's filter removes, summed over all orders.
    """
    total = sum(c[0] for c in counts.values())
    steps, over_all = [], dict.fromkeys(filters, 0)
    for order in map("".join, itertools.permutations(filters)):
        before, kept = 0, total
        for step, name in enumerate(order, 1):
            bit = 1 << filters.index(name)
            failing = [(mask, c) for mask, c in counts.items() if mask & bit]
            here = [c for mask, c in failing if not mask & before]
            removed, good, toxic = (sum(c[k] for c in here) for k in range(3))
            kept -= removed
            over_all[name] += removed
            alone = sum(c[0] for mask, c in failing if mask == bit)
            steps.append((order, step, kept, removed, sum(c[0] for _, c in failing) - removed, alone, good, toxic))
            before |= bit
    for s in steps:
        yield (*s, over_all[s[0][s[1] - 1]])


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step and counts (see audit_orders) for each part, all 120 orders of the filters A to E and their five steps.

    A document is good or toxic if any row of ``labels`` (id, quality, toxic) says 1; null labels and ids say nothing. See failure_masks for nulls, repeats and
    empty texts. An empty table gives an empty result.
    """
    one = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(one("quality"), one("toxic"))
    masks = stored(failure_masks(docs, id_col, text_col, part_col), "masks").join(small(cut(known)), "doc_id", "left")
    says = lambda c: F.coalesce(F.col(c), F.lit(0))
    counted = mask_counts(masks.select("part", "mask", says("quality"), says("toxic")).rdd)
    rows = counted.flatMap(lambda x: ((x[0], *step) for step in audit_orders(x[1])))
    schema = (
        "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    )
    return docs.sparkSession.createDataFrame(rows, schema)
