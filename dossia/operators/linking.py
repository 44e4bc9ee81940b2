"""Linking of documents that share a key, and the cards they make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.functions.canon import canon, digits
from dossia.operators.checkpoints import cut
from dossia.operators.components import components
from dossia.operators.folding import assign_cards, card_states
from dossia.schema import CARD_COLUMNS, CARD_INTEGERS, EPTS, LINK_KEYS, PTS, STS_BACK, STS_FRONT


def card_values(doc_type: Column, fields: Column) -> list[Column]:
    """The card columns that a document fills; empty ones are null."""
    value = lambda k: F.element_at(fields, k)
    number = canon("doc_number", value("doc_number"))
    out = {c: value(c) for c in CARD_COLUMNS if c != "sts_number"}
    out |= {c: canon(c, value(c)) for c in ("vin", "plate")}
    out["sts_number"] = F.when(doc_type.isin(STS_FRONT, STS_BACK), number)
    of_front = F.when(F.coalesce(value("pts_number"), F.lit("")) != "", canon("pts_number", value("pts_number")))
    out["pts_number"] = F.when(doc_type.isin(PTS, EPTS), F.coalesce(F.nullif(number, F.lit("")), value("pts_number"))).when(doc_type == STS_FRONT, of_front).otherwise(value("pts_number"))
    out |= {c: digits(F.coalesce(value(c), F.lit(""))) for c in CARD_INTEGERS}
    text = {c: F.nullif(out[c], F.lit("")) for c in CARD_COLUMNS}
    return [(text[c].try_cast("int") if c in CARD_INTEGERS else text[c]).alias(c) for c in CARD_COLUMNS]


def link_documents(docs: DataFrame, seq: str = "seq", keys: list[str] | None = None) -> DataFrame:
    """docs with component: the smallest seq of all documents reached by shared keys.

    Documents and key values are nodes of one graph, so a value that many documents share costs one edge each.
    """
    keys = LINK_KEYS if keys is None else keys
    named = F.explode(F.array(*[F.when(F.col(k) != "", F.concat(F.lit(f"{k}:"), k)) for k in keys])).alias("key")
    held = docs.select(F.col(seq).cast("long").alias("doc"), named).where("key is not null").distinct()
    # A key's node is its first document: star edges from there reach all others.
    first = held.groupBy("key").agg(F.min("doc").alias("first"))
    edges = held.join(first, "key").select(F.col("doc").alias("a"), F.col("first").alias("b"))
    found = components(edges)
    joined = docs.join(found, F.col(seq) == F.col("node"), "left")
    return joined.withColumn("component", F.coalesce("component", F.col(seq).cast("long"))).drop("node")


def golden_record(docs: DataFrame, columns: list[str], component: str = "component", seq: str = "seq") -> DataFrame:
    """One row for each component with each column's latest value; an approximation of fold_cards that needs no Python."""
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(seq, c)))[c].alias(c)
    return docs.groupBy(component).agg(*map(latest, columns), F.count("*").alias("doc_count"))


def fold_cards(docs: DataFrame, seq: str = "seq", component: str = "component") -> DataFrame:
    """seq, card of each document and the card's values after all documents: documents in order of seq, each linked to a card now.

    A document joins the first card with its vin, else with its sts_number, else with its pts_number; further cards that match merge into
    that one, whose own values win; then the document's values overwrite the card's. Keys that were overwritten no longer match. A card's number is
    the seq of the document that made it. Documents that ever meet share a component; only the events that change keys are folded in order
    (see ``folding.assign_cards``).
    """
    members = assign_cards(docs, seq, component)
    states = cut(card_states(docs, members, CARD_COLUMNS, seq))
    return members.select("seq", "card").join(states.select("card", *CARD_COLUMNS), "card").select("seq", "card", *CARD_COLUMNS)


def folded_cards(docs: DataFrame, seq: str = "seq", component: str = "component") -> DataFrame:
    """One row for each card that fold_cards gives: card, the columns, doc_count, first_seq."""
    return card_states(docs, assign_cards(docs, seq, component), CARD_COLUMNS, seq)


def doc_counts(cards: DataFrame, docs: DataFrame, card_id: str, doc_card: str, doc_type: str) -> DataFrame:
    """cards with doc_count (0 if none) and doc_types (sorted, comma-joined, null if none)."""
    counts = docs.groupBy(F.col(doc_card).alias("_card")).agg(
        F.count("*").alias("doc_count"), F.array_join(F.array_sort(F.collect_set(doc_type)), ",").alias("doc_types")
    )
    joined = cards.join(counts, F.col(card_id) == F.col("_card"), "left").drop("_card")
    return joined.withColumn("doc_count", F.coalesce("doc_count", F.lit(0).cast("long")))


def any_key(columns: list[str], value: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c) == value for c in columns])
