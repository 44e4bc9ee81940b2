import random

import pyarrow as pa
from pyspark.sql import functions as F

from dossia.operators import folding, linking
from dossia.operators.components import components
from dossia.schema import CARD_COLUMNS, LINK_KEYS, STS_BACK, STS_FRONT


def cards_in_order(log):
    """Cards after each document in turn, over all documents at once."""
    cards, of = {}, {}
    for seq, values in log:
        hits = []
        for k in LINK_KEYS:
            for n in sorted(cards):
                if values.get(k) and cards[n].get(k) == values[k] and n not in hits:
                    hits.append(n)
        card = hits[0] if hits else seq
        for other in hits[1:]:
            for k, v in cards.pop(other).items():
                cards[card].setdefault(k, v)
            for d in of:
                if of[d] == other:
                    of[d] = card
        cards.setdefault(card, {}).update(values)
        of[seq] = card
    return cards, of


def frame(spark, log):
    kinds = ", ".join(f"{c} {'int' if c == 'year' else 'string'}" for c in CARD_COLUMNS if c in (*LINK_KEYS, "color", "year"))
    rows = [(seq, *[v.get(c) for c in CARD_COLUMNS if c in (*LINK_KEYS, "color", "year")]) for seq, v in log]
    df = spark.createDataFrame(rows, f"seq long, {kinds}")
    return df.withColumns({c: F.lit(None).cast("int" if c in ("power_kw", "power_hp", "engine_volume", "max_mass", "curb_mass") else "string") for c in CARD_COLUMNS if c not in df.columns})


def test_fold_equals_whole_log(spark):
    rng = random.Random(2)
    log = []
    for seq in range(300):
        values = {k: f"{k}{rng.randint(0, 60)}" for k in LINK_KEYS if rng.random() < 0.5}
        values |= {"color": rng.choice("abc")} if rng.random() < 0.5 else {}
        values |= {"year": rng.randint(2000, 2020)} if rng.random() < 0.5 else {}
        log.append((seq, values))
    cards, of = cards_in_order(log)
    got = linking.fold_cards(linking.link_documents(frame(spark, log))).collect()
    assert {r.seq: r.card for r in got} == of
    assert all({c: r[c] for c in CARD_COLUMNS if r[c] is not None} == cards[r.card] for r in got)


def checked(spark, log, **options):
    cards, of = cards_in_order(log)
    linked = linking.link_documents(frame(spark, log))
    members = {r.seq: r.card for r in folding.assign_cards(linked, **options).collect()}
    assert members == of
    got = {r.card: r for r in linking.folded_cards(linked).collect()}
    assert {n: {c: r[c] for c in CARD_COLUMNS if r[c] is not None} for n, r in got.items()} == cards
    assert sum(r.doc_count for r in got.values()) == len(log)


def test_fold_of_logs_with_many_conflicts(spark):
    """Few key values: keys flip, cards merge, forget keys and merge again; chunks of a few documents."""
    for seed, spread, n in ((1, 3, 120), (2, 8, 200), (3, 20, 200)):
        rng = random.Random(seed)
        log = []
        for seq in range(n):
            values = {k: f"{k}{rng.randint(0, spread)}" for k in LINK_KEYS if rng.random() < 0.6}
            values |= {"color": rng.choice("abc")} if rng.random() < 0.4 else {}
            values |= {"year": rng.randint(2000, 2020)} if rng.random() < 0.4 else {}
            log.append((seq * 7 - 50, values))
        checked(spark, log, chunk_rows=30)


def test_merged_values_follow_the_order_of_merges(spark):
    """Gaps are filled by the cards merged first; a document's own values stay."""
    log = [
        (1, {"vin": "A", "color": "a"}), (2, {"sts_number": "S", "color": "s", "year": 1}), (3, {"pts_number": "P", "year": 2, "plate": "p"}),
        (4, {"vin": "A", "sts_number": "S", "pts_number": "P"}), (5, {"vin": "B", "body": "b"}), (6, {"vin": "A", "year": 9}), (7, {"vin": "A", "sts_number": "T"}), (8, {"sts_number": "S"}), (9, {"vin": "B", "sts_number": "S"}), (10, {}), (11, {}),
    ]
    log = [(n, {k: v for k, v in values.items() if k != "body" and k != "plate"}) for n, values in log]
    checked(spark, log)
    got = {r.card: r for r in linking.folded_cards(linking.link_documents(frame(spark, log))).collect()}
    assert (got[1].color, got[1].year, got[1].sts_number) == ("a", 9, "T") and {10, 11} <= set(got)


def test_a_large_component_has_few_events(spark):
    """200,000 documents of one car, with two bare orders of keys and one merge: the fold sees a handful of them."""
    n = 200_000
    docs = spark.range(n).select(
        F.col("id").alias("seq"), F.lit(0).cast("long").alias("component"), F.when((F.col("id") % 2 == 0) | (F.col("id") == n // 2 + 1), "V").alias("vin"),
        F.when(F.col("id") % 2 == 1, "S").alias("sts_number"), F.lit(None).cast("string").alias("pts_number"), (F.col("id") % 1000).cast("string").alias("color"),
    )
    members = folding.assign_cards(docs)
    states = folding.card_states(docs, members, ["vin", "sts_number", "color"]).collect()
    assert [(r.card, r.vin, r.sts_number, r.color, r.doc_count) for r in states] == [(0, "V", "S", "999", n)]
    # Values of the first card alone: the merged one's are older or overwritten.
    assert members.groupBy("turn").count().count() == 2


def test_forgotten_key_gives_two_cards(spark):
    log = [(1, {"vin": "A", "sts_number": "1"}), (2, {"vin": "B", "sts_number": "1"}), (3, {"vin": "A"}), (4, {})]
    linked = linking.link_documents(frame(spark, log))
    assert {r.seq: r.component for r in linked.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.seq: r.card for r in linking.fold_cards(linked).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components_of_long_path_and_hub(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[1000 + k] == 1000 for k in range(300)) and 5000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_card_values(spark):
    fields = F.create_map(*map(F.lit, ["vin", "xta21170ok1234567", "doc_number", "99 01 123456", "pts_number", "63 OX 123456", "year", "2015 г.", "unknown", "x", "color", ""]))
    front = spark.range(1).select(*linking.card_values(F.lit(STS_FRONT), fields)).first()
    assert (front.vin, front.sts_number, front.pts_number, front.year, front.color) == ("XTA211700K1234567", "9901123456", "63ОХ123456", 2015, None)
    back = spark.range(1).select(*linking.card_values(F.lit(STS_BACK), F.create_map(F.lit("doc_number"), F.lit("1")))).first()
    assert back.sts_number == "1" and back.pts_number is None


def test_components_follow_each_other_in_a_task():
    """One call folds all components of a task, also one that batches cut in two."""
    rows = [(1, 1, True, 0, "V1", None), (1, 1, False, 0, "V1", None), (1, 5, True, 1, "V1", "S1"), (1, 5, False, 2, None, "S1"), (2, 7, True, 3, "V2", None), (2, 7, False, 4, "V3", None)]
    kinds = [("component", pa.int64()), ("at", pa.int64()), ("event", pa.bool_()), ("kind", pa.int64()), ("vin", pa.string()), ("sts_number", pa.string())]
    table = pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds, strict=True)], names=[n for n, _ in kinds])
    table = table.append_column("pts_number", pa.nulls(len(rows), pa.string()))
    for size in (1, 3, 10):
        told = pa.Table.from_batches(folding._simulate(iter(table.to_batches(max_chunksize=size)))).to_pylist()
        assert [tuple(r.values()) for r in told] == [(1, 1, 0, 1, 0), (1, 5, 2, 1, 0), (2, 7, 4, None, None)]
    assert list(folding._simulate(iter([]))) == []
