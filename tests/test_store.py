import os
import random

from pyspark.sql import functions as F

from dossia.operators import linking
from dossia.schema import CARD_COLUMNS, LINK_KEYS
from dossia.sources import store

SCHEMA = "seq long, vin string, sts_number string, pts_number string, color string, year int"


def a_log(n, spread, seed):
    rng = random.Random(seed)
    key = lambda k: f"{k}{rng.randint(0, spread)}" if rng.random() < 0.5 else rng.choice([None, None, ""])
    return [(seq, *map(key, LINK_KEYS), rng.choice(["a", "b", None]), rng.choice([2001, 2002, None])) for seq in range(n)]


def filled(df):
    return df.withColumns({c: F.lit(None).cast("int" if c in ("power_kw", "power_hp", "engine_volume", "max_mass", "curb_mass") else "string") for c in CARD_COLUMNS if c not in df.columns})


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_batches_give_what_one_fold_gives(spark, tmp_path):
    path, log = str(tmp_path / "store"), a_log(150, 25, 4)
    for rows in (log[:90], log[90:91], log[91:]):
        store.add_batch(spark, path, spark.createDataFrame(rows, SCHEMA), parts=8)
    linked = linking.link_documents(filled(spark.createDataFrame(log, SCHEMA)))
    row = lambda r: tuple(r[c] for c in ("card", *CARD_COLUMNS, "doc_count", "first_seq"))
    want = sorted(map(row, linking.folded_cards(linked).collect()), key=repr)
    state = lambda: sorted(map(row, store.read_table(spark, path, "cards").collect()), key=repr)
    assert state() == want
    of = {r.seq: r.component for r in linked.select("seq", "component").collect()}
    assert {r.seq: r.component for r in store.read_table(spark, path, "members").collect()} == of
    store.add_batch(spark, path, spark.createDataFrame(log[60:], SCHEMA), parts=8)  # again, after a failure
    assert state() == want and store.read_table(spark, path, "members").count() == len(log)
    seen = store.read_table(spark, path, "seen").collect()
    assert {(r.kind, r.value): r.component for r in seen} == {(k, v): of[r[0]] for r in log for k, v in zip(LINK_KEYS, r[1:4], strict=True) if v}
    assert len(seen) == len({(r.kind, r.value) for r in seen})


def test_a_batch_writes_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "store")
    first = [(n, f"V{n}", f"S{n}", None, "a", 2000) for n in range(400)]
    store.add_batch(spark, path, spark.createDataFrame(first, SCHEMA))
    before = {t: files(f"{path}/{t}") for t in store.SCHEMAS}
    written = store.add_batch(spark, path, spark.createDataFrame([(900, "V7", None, None, "b", None), (901, "V8", "S9", None, None, None)], SCHEMA))
    for table, parts in written.items():
        assert 0 < len(parts) <= 4
        kept = before[table] & files(f"{path}/{table}")
        changed = {int(f.split("part=")[1].split("/")[0]) for f in before[table] ^ files(f"{path}/{table}")}
        assert changed <= set(parts) and len(kept) > 30
    assert store.read_table(spark, path, "members").count() == 402
    cards = {r.card: r for r in store.read_table(spark, path, "cards").collect()}
    assert cards[7].color == "b" and cards[8].sts_number == "S9" and 9 not in cards and len(cards) == 399
    plan = store.look_up(spark, path, spark.createDataFrame([(1, "V7", None, None)], "seq long, vin string, sts_number string, pts_number string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(part") + plan.count("PartitionFilters: [(part") + plan.count("PartitionFilters: [part") >= 1


def test_look_up_by_priority(spark, tmp_path):
    path = str(tmp_path / "store")
    store.add_batch(spark, path, spark.createDataFrame([(1, "V", None, None, None, None), (2, None, "S", None, None, None), (3, None, None, "P", None, None), (4, "W", "T", None, None, None), (5, "W", "U", None, None, None)], SCHEMA))
    asked = [(10, "V", "S", "P"), (11, "none", "S", "P"), (12, None, "", "P"), (13, None, None, None), (14, "x", "y", "z"), (15, None, "T", None), (16, None, "U", None)]
    got = {r.seq: r.card for r in store.look_up(spark, path, spark.createDataFrame(asked, "seq long, vin string, sts_number string, pts_number string")).collect()}
    assert got == {10: 1, 11: 2, 12: 3, 13: None, 14: None, 15: None, 16: 4}  # T was overwritten by U
    assert [r.vin for r in store.stored_cards(spark, path, [1]).collect()] == ["V"]
