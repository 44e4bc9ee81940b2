"""A store of documents and cards in Parquet that batches are added to: only the parts that a batch touches are read and written again.

Three tables lie in one folder, each in ``PARTS`` partitions: ``members`` (documents with their component) and ``cards`` by a hash of the
component, ``seen`` (each value of a link key that a document ever had, with its component) by a hash of the key. A batch looks its keys up in
the partitions of ``seen`` that they fall in, links documents and the components met, and folds those components alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.operators.checkpoints import cut
from dossia.operators.components import components
from dossia.operators.folding import assign_cards, card_states
from dossia.schema import CARD_COLUMNS, CARD_INTEGERS, LINK_KEYS

PARTS = 64

_VALUES = ", ".join(f"{c} {'int' if c in CARD_INTEGERS else 'string'}" for c in CARD_COLUMNS)
SCHEMAS = {
    "members": f"seq long, {_VALUES}, component long, part int",
    "cards": f"card long, {_VALUES}, doc_count long, first_seq long, component long, part int",
    "seen": "kind string, value string, component long, part int",
}


def _part(parts: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")


def create_store(spark: SparkSession, path: str) -> None:
    """Empty tables where there are none; tables that are there stay."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("part").parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str, parts: list[int] | None = None) -> DataFrame:
    """A table of the store, or some of its partitions: the others' files aren't opened."""
    rows = spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")
    return rows if parts is None else rows.where(F.col("part").isin(parts))


def _touched(rows: DataFrame) -> list[int]:
    return sorted(r.part for r in rows.select("part").distinct().collect())  # PARTS at most


def _write(rows: DataFrame, path: str, name: str) -> None:
    """Replaces the partitions that rows fall in. rows are checkpointed, as they come from the files that go."""
    columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    by_part = rows.select(*columns).hint("rebalance", "part")  # a part that holds a large component is written by several tasks
    by_part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/{name}")


def _keys(docs: DataFrame, *carried: str) -> DataFrame:
    """kind, value and carried columns for each link key that a document has."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in LINK_KEYS])).alias("key")
    return docs.select(*carried, each).where("key.value <> ''").select("key.*", *carried)


def look_up(spark: SparkSession, path: str, docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """seq, card for each document: the stored card with its vin, else with its sts_number, else with its pts_number (null if there is none).

    docs: seq and the link keys. Only the partitions of ``seen`` and ``cards`` that the documents' keys lead to are read.
    """
    asked = cut(_keys(docs, "seq").withColumn("part", _part(parts, "kind", "value")))
    seen = read_table(spark, path, "seen", _touched(asked)).select("kind", "value", "component")
    led = cut(asked.select("kind", "value").distinct().join(seen, ["kind", "value"]).select("component").distinct().withColumn("part", _part(parts, "component")))
    cards = read_table(spark, path, "cards", _touched(led)).join(led.select("component"), "component", "left_semi")
    held = _keys(cards, "card")
    order = F.element_at(F.create_map(*[F.lit(x) for n, k in enumerate(LINK_KEYS) for x in (k, n)]), F.col("kind"))
    found = asked.drop("part").join(held, ["kind", "value"]).groupBy("seq").agg(F.min(F.struct(order.alias("order"), "card"))["card"].alias("card"))
    return docs.select("seq").join(found, "seq", "left")


def stored_cards(spark: SparkSession, path: str, components_: list[int], parts: int = PARTS) -> DataFrame:
    """The cards of a few components, from their partitions alone."""
    named = spark.createDataFrame([(c,) for c in components_], "component long").withColumn("part", _part(parts, "component"))
    return read_table(spark, path, "cards", _touched(named)).where(F.col("component").isin(components_))


def add_batch(spark: SparkSession, path: str, docs: DataFrame, parts: int = PARTS) -> dict[str, list[int]]:
    """Adds documents (seq and card columns, missing ones are null) to the store; the partitions written, by table.

    The result is that of one fold of all documents by seq, in whatever batches they come. A batch that is added again after a failure changes
    nothing more: a document is known by its seq. Documents without keys are components of their own.
    """
    create_store(spark, path)
    empty = [F.lit(None).cast("int" if c in CARD_INTEGERS else "string").alias(c) for c in CARD_COLUMNS if c not in docs.columns]
    docs = cut(docs.select("*", *empty).select("seq", *CARD_COLUMNS).dropDuplicates(["seq"]))
    named = cut(_keys(docs, "seq").withColumn("part", _part(parts, "kind", "value")))
    seen = read_table(spark, path, "seen", _touched(named))
    met = cut(named.select("kind", "value", "seq").join(seen.select("kind", "value", "component"), ["kind", "value"]))
    # Edges within the batch, and to the components that hold one of its keys.
    first = named.groupBy("kind", "value").agg(F.min("seq").alias("first"))
    edges = named.join(first, ["kind", "value"]).select(F.col("seq").alias("a"), F.col("first").alias("b")).unionByName(met.select(F.col("seq").alias("a"), F.col("component").alias("b")))
    joined = cut(components(edges).select("node", F.col("component").alias("into")))
    new = docs.join(joined, F.col("seq") == F.col("node"), "left").select(docs["*"], F.coalesce("into", "seq").alias("component"))
    old = met.select("component").distinct().join(joined, F.col("component") == F.col("node"), "left").select("component", F.coalesce("into", "component").alias("into"))
    old, new = cut(old), cut(new)

    both = old.select("component").unionByName(old.select(F.col("into").alias("component"))).unionByName(new.select("component")).distinct()
    both = cut(both.withColumn("part", _part(parts, "component")))
    places = _touched(both)
    before = read_table(spark, path, "members", places)
    known = before.join(old, "component", "left").select("seq", *CARD_COLUMNS, F.coalesce("into", "component").alias("component"), (F.col("into") != F.col("component")).alias("moves"))
    every = known.unionByName(new.withColumn("moves", F.lit(True)))
    # A row of an attempt that failed counts once, in the smaller component.
    once = every.groupBy("seq").agg(F.min(F.struct("component", *[c for c in CARD_COLUMNS])).alias("r"), F.max("moves").alias("moves")).select("seq", "r.*", "moves")
    members = cut(once.withColumn("part", _part(parts, "component")))

    changed = _keys(members.where("moves"), "component").groupBy("kind", "value").agg(F.min("component").alias("component")).withColumn("part", _part(parts, "kind", "value"))
    changed = cut(changed)
    kept = read_table(spark, path, "seen", _touched(changed)).join(changed.select("kind", "value"), ["kind", "value"], "left_anti")
    seen_now = cut(kept.unionByName(changed, allowMissingColumns=True))

    touched = members.join(both.select("component").distinct(), "component", "left_semi")
    states = card_states(touched, assign_cards(touched), CARD_COLUMNS)
    states = states.join(touched.select(F.col("seq").alias("card"), "component"), "card").withColumn("part", _part(parts, "component"))
    rest = read_table(spark, path, "cards", places).join(both.select("component"), "component", "left_anti")
    cards = cut(rest.unionByName(states, allowMissingColumns=True))
    # Cards and members first: a key leads to a component that is there.
    written = {"members": places, "cards": places, "seen": _touched(changed)}
    for name, rows in (("members", members), ("cards", cards), ("seen", seen_now)):
        _write(rows, path, name)
        gone = set(written[name]) - set(_touched(rows))
        for part in sorted(gone):  # all its rows went to other partitions
            _drop_part(spark, f"{path}/{name}/part={part}")
    return written


def _drop_part(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
