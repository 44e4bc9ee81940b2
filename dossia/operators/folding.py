"""Documents folded into cards at merge events.

Which card a document joins depends on keys alone, and only few documents change what keys point to. Between two such events a document with given keys is a plain
update of the card that the keys name. So only the events of a component are folded in order, by keys; all other documents are told their
card by a join, and a card's values are an aggregate: its own latest value of each column, else that of the cards merged into it, in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dossia.operators.checkpoints import cut
from dossia.schema import LINK_KEYS

#: Documents of one chunk of the order; a window holds one component's documents of a chunk.
CHUNK_ROWS = 100_000
#: Rows that a fold sends on at once.
TOLD_ROWS = 10_000


class Cards:
    """Cards and the keys that point to them, while documents come in."""

    def __init__(self):
        self.keys: dict[int, dict[str, str]] = {}
        self.holders: dict[tuple[str, str], set[int]] = {}
        self.children: dict[int, list[int]] = {}

    def hits(self, keys: dict[str, str]) -> list[int]:
        """Cards with one of the keys: by the first key that meets, then by number."""
        return list(dict.fromkeys(n for k in LINK_KEYS if k in keys for n in sorted(self.holders.get((k, keys[k]), ()))))

    def add(self, seq: int, keys: dict[str, str]) -> int:
        """A document's card; further cards that its keys meet merge into that one."""
        card, *others = self.hits(keys) or [seq]
        mine = self.keys.setdefault(card, {})
        self.children.setdefault(card, [])
        for other in others:
            for k, v in self.keys.pop(other).items():
                self.holders[k, v].discard(other)
                if k not in mine:
                    self._point(card, k, v)
            self.children[card].append(other)
        for k, v in keys.items():
            if mine.get(k) != v:
                if k in mine:
                    self.holders[k, mine[k]].discard(card)
                self._point(card, k, v)
        return card

    def _point(self, card: int, k: str, v: str) -> None:
        self.keys[card][k] = v
        self.holders.setdefault((k, v), set()).add(card)

    def settled(self, keys: dict[str, str]) -> int | None:
        """The card that a document with these keys would join without changing any key; None if it would change one."""
        hits = self.hits(keys)
        return hits[0] if len(hits) == 1 and keys.items() <= self.keys[hits[0]].items() else None

    def places(self) -> dict[int, tuple[int, int]]:
        """For each card the card that it ended in, and its turn there: a card's own values come first, then those of each merged card and of what had merged into it."""
        out: dict[int, tuple[int, int]] = {}
        for root in self.keys:
            todo, turn = [root], 0
            while todo:
                card = todo.pop()
                out[card] = (root, turn)
                turn += 1
                todo += reversed(self.children[card])
        return out


_TOLD = pa.schema([("component", pa.int64()), ("at", pa.int64()), ("kind", pa.int64()), ("card", pa.int64()), ("turn", pa.int32())])


def _simulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components one after another: of each the rows at events, in order, each followed by the kinds of documents that come before the next one."""
    told: list[tuple] = []
    now, cards, seen = None, Cards(), []

    def end() -> None:
        if seen:
            places = cards.places()
            told.extend((now, at, kind, *(places[card] if card is not None else (None, None))) for at, kind, card in seen)

    def taken() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*told, strict=True), _TOLD.types, strict=True)]
        told.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_TOLD)

    for batch in batches:
        for component, at, event, kind, *values in zip(*(batch.column(c).to_pylist() for c in ("component", "at", "event", "kind", *LINK_KEYS)), strict=True):
            if component != now:
                end()
                now, cards, seen = component, Cards(), []
            keys = {k: v for k, v in zip(LINK_KEYS, values, strict=True) if v is not None}
            if event:
                cards.add(at, keys)
            else:
                seen.append((at, kind, cards.settled(keys)))
            if len(told) >= TOLD_ROWS:
                yield taken()
    end()
    if told:
        yield taken()


def _at_event(docs: DataFrame, events: DataFrame, width: int) -> DataFrame:
    """docs with ``at``: the last event of their component up to their own place. Each chunk of the order is looked at apart, then the chunks."""
    chunk = F.floor(F.col("seq") / width)
    both = docs.select("component", "seq", "kind", F.lit(None).cast("long").alias("event")).unionByName(events.select("component", "seq", F.lit(None).cast("long").alias("kind"), F.col("seq").alias("event")))
    both = both.withColumn("chunk", chunk)
    within = F.last("event", ignorenulls=True).over(W.partitionBy("component", "chunk").orderBy("seq", F.col("event").isNull()).rowsBetween(W.unboundedPreceding, 0))
    placed = both.withColumn("at", within).where("event is null").drop("event")
    each = both.groupBy("component", "chunk").agg(F.max("event").alias("last"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy("component").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    before = each.select("component", "chunk", before.alias("before"))
    return placed.join(before, ["component", "chunk"]).select("component", "seq", "kind", F.coalesce("at", "before").alias("at"))


def assign_cards(docs: DataFrame, seq: str = "seq", component: str = "component", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """seq, card, turn of each document: the card it ended in, and the turn of its values there (see ``Cards.places``); checkpointed.

    docs: the link keys of documents with their components; seq is unique, null or empty keys say nothing. Components whose documents all have the same keys need no fold. Of others the first document of
    each set of keys is an event, to begin with; while documents turn out to change keys, the first of them become events too (twice as many each
    time), until none is left. A task holds the events of one component at a time, and for each the sets of keys that follow before the next.
    """
    keys = [F.nullif(F.col(k), F.lit("")).alias(k) for k in LINK_KEYS]
    rows = cut(docs.select(F.col(seq).cast("long").alias("seq"), F.col(component).cast("long").alias("component"), *keys))  # values are made canonical once, not once for each use
    same = ["component", *LINK_KEYS]
    sets = cut(rows.groupBy(*same).agg(F.min("seq").alias("first"), F.count("*").alias("n")).withColumn("kind", F.monotonically_increasing_id()))
    per = cut(sets.groupBy("component").agg(F.count("*").alias("sets"), F.min("first").alias("least"), F.sum("n").alias("n"), F.bool_or(F.coalesce(*LINK_KEYS).isNull()).alias("bare")))
    plain = per.where("sets = 1 and (not bare or n = 1)").select("component", F.col("least").alias("card"))
    mixed = per.where("not (sets = 1 and (not bare or n = 1))").select("component")
    easy = rows.join(plain, "component").select("seq", "card", F.lit(0).alias("turn"))
    eq = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in same]
    hard = rows.join(mixed, "component", "left_semi").alias("d").join(sets.alias("s"), eq).select("d.component", "d.seq", "s.kind")
    hard = cut(hard)
    low, high, n = hard.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    if not n:
        return cut(easy)
    width = max(1, -(-(high - low + 1) * chunk_rows // n))
    # A document with another set of keys than the one before it in its component.
    order = W.partitionBy("component", F.floor(F.col("seq") / width)).orderBy("seq")
    starts = cut(hard.withColumn("new", ~F.col("kind").eqNullSafe(F.lag("kind").over(order))).where("new").drop("new"))
    # Documents without keys are cards of their own.
    bare = sets.where(F.coalesce(*LINK_KEYS).isNull()).select("kind")
    events = cut(hard.groupBy("component", "kind").agg(F.min("seq").alias("seq")).unionByName(hard.join(bare, "kind", "left_semi").select("component", "kind", "seq")).distinct())
    more = 1
    while True:
        placed = cut(_at_event(hard, events, width))
        kinds = placed.select("component", "at", "kind").distinct().withColumn("event", F.lit(False))
        both = kinds.unionByName(events.select("component", F.col("seq").alias("at"), "kind", F.lit(True).alias("event"))).join(sets.select("kind", *LINK_KEYS), "kind")
        # Components follow each other in a task: most are small, and a call of Python for each would cost more than its fold.
        ordered = both.repartition("component").sortWithinPartitions("component", "at", F.col("event").desc())
        told = cut(ordered.mapInArrow(_simulate, "component long, at long, kind long, card long, turn int"))
        wrong = told.where("card is null").select("component", "at", "kind")
        wrong = wrong.join(bare, "kind", "left_anti")
        if wrong.isEmpty():
            break
        first = F.row_number().over(W.partitionBy("component", "at", "kind").orderBy("seq"))
        late = placed.join(wrong, ["component", "at", "kind"]).join(starts.select("component", "seq"), ["component", "seq"], "left_semi")
        least = placed.join(wrong, ["component", "at", "kind"]).groupBy("component", "at", "kind").agg(F.min("seq").alias("seq"))
        late = late.withColumn("k", first).where(F.col("k") <= more).select("component", "kind", "seq").unionByName(least.select("component", "kind", "seq"))
        events, more = cut(events.unionByName(late).distinct()), more * 2
    own = placed.join(bare, "kind", "left_semi").select("seq", F.col("seq").alias("card"), F.lit(0).alias("turn"))
    folded = placed.join(told, ["component", "at", "kind"]).join(bare, "kind", "left_anti").select("seq", "card", "turn")
    return cut(easy.unionByName(folded).unionByName(own))


def card_states(docs: DataFrame, members: DataFrame, columns: list[str], seq: str = "seq") -> DataFrame:
    """card, the columns, doc_count, first_seq of each card: an aggregate that tasks begin where the documents lie."""
    value = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct((-F.col("_turn")).alias("t"), F.col("_seq").alias("s"), F.col(c).alias("v"))))["v"].alias(c)
    rows = docs.select(F.col(seq).cast("long").alias("_seq"), *columns).join(members.select(F.col("seq").alias("_seq"), "card", F.col("turn").alias("_turn")), "_seq")
    return rows.groupBy("card").agg(*map(value, columns), F.count("*").alias("doc_count"), F.min("_seq").alias("first_seq"))
