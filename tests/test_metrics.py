import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from dossia.operators import checkpoints, metrics


def test_robustness_counts_the_last_record_only(spark):
    truth = spark.createDataFrame([("a", "pts", {"year": "2001"}), ("b", "pts", {"year": "2002"})], "id string, doc_type string, fields map<string,string>")
    rows = [("a", "blur:2", "9"), ("a", "blur:2", "2001"), ("b", "blur:2", "2002"), ("b", "blur:2", "1"), ("a", "clean", "1"), ("a", "clean", "2001")]
    records = spark.createDataFrame([(i, v, "pts", 1.0, None, {"year": y}) for i, v, y in rows], "id string, variant string, pred_doc_type string, seconds double, error string, fields map<string,string>").coalesce(1)
    got = {(r.kind, r.level): r.accuracy for r in metrics.robustness(metrics.scored_fields(records, truth)).collect()}
    assert got == {("blur", 2): 0.5, ("blur", 0): 1.0}


def test_fingerprint_tells_where_a_null_is(spark):
    of = lambda rows: metrics.fingerprint(spark.createDataFrame(rows, "id long, a string, b string"), "id", F.col("a"), F.col("b")).first().fingerprint
    assert len({of([(1, "x", None)]), of([(1, None, "x")]), of([(1, "x", "")])}) == 3
    assert of([(1, "x", "y"), (2, None, None)]) == of([(2, None, None), (1, "x", "y")])


def test_no_own_checkpoint_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        checkpoints.shared_dir(Session())


def test_exact_median_of_ties_even_counts_and_odd_values(spark):
    rng = random.Random(6)
    groups = {
        "even": [1.0, 2.0, 3.0, 10.0], "odd": [5.0, 1.0, 9.0], "one": [7.5], "ties": [3.0] * 500 + [4.0] * 500, "same": [2.0] * 99, None: [0.0, 4.0],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-4, 4) for _ in range(401)], "ends": [-1.7e308, 1.7e308, 1.6e308], "many": [rng.gauss(0, 1) for _ in range(2000)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("nothing", None), ("one", float("nan"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for ranges, few in ((32, 5), (256, 4096)):
        got = {r.g: r.median for r in metrics.exact_median(df, "g", "x", ranges, few).collect()}
        assert got.keys() == groups.keys()
        assert all(math.isclose(got[g], statistics.median(vs), rel_tol=1e-12) for g, vs in groups.items())
    assert metrics.exact_median(df.limit(0), "g", "x").collect() == []


def test_medians_send_no_values(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "double(id) AS x")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a table too large for Spark to guess that few places are left
    try:
        medians = metrics.exact_median(df, "g", "x")
        plan = medians._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.g: r.median for r in medians.collect()} == {0: 49.5, 1: 49.0, 2: 50.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fingerprint_by_trees_of_any_depth(spark):
    rows = [(n, f"text {n}") for n in range(3000)] + [(None, "a"), (None, None)]
    df = spark.createDataFrame(rows, "id long, a string")
    of = lambda d, levels: metrics.fingerprint(d, "id", F.col("a"), levels=levels).first().fingerprint
    for levels in (1, 2, 3):
        assert of(df.repartition(7), levels) == of(df.orderBy(F.desc("id")), levels)
        assert of(df, levels) != of(df.withColumn("a", F.when(F.col("id") == 77, "x").otherwise(F.col("a"))), levels)
    assert of(df.limit(0), 1) == of(df.limit(0), 2) != of(df, 2)


def test_reports(spark):
    scores = spark.createDataFrame(
        [("tesseract", "clean", 12, 0.5, 0.25, 1.0, 0.1, 2.0), ("vlm_qwen3-vl-8b", "photo", 12, 0.9, 0.5, 1.0, 0.02, 3.24), ("vlm_qwen3-vl-8b", "clean", 12, 1.0, 1.0, 1.0, 0.0, 3.0), ("x", "blur:2", 1, 0.0, 0.0, 0.0, 1.0, 1.0)],
        "engine string, variant string, documents int, field_accuracy double, document_accuracy double, doc_type_accuracy double, mean_cer double, median_seconds double",
    )
    lines = metrics.report(scores, {"clean": "Скан", "photo": "Фото"}).split("\n")
    assert [x.split(" | ")[:2] for x in lines[2:]] == [["| Qwen3-VL 8B", "Скан"], ["| Qwen3-VL 8B", "Фото"], ["| Tesseract 5 + правила", "Скан"]] and "3.2" in lines[3]
    text = metrics.between_marks("a <1> old <2> b", "new", "<1>", "<2>")
    assert text == "a <1>\nnew\n<2> b" and metrics.between_marks("a <2> <1>", "x", "<1>", "<2>") is None
    truth = spark.createDataFrame([("a", "pts", {"year": "2001"})], "id string, doc_type string, fields map<string,string>")
    records = spark.createDataFrame([("a", "clean", "pts", 1.0, None, {"year": "2001"}), ("a", "blur:2", "pts", 1.0, None, {})], "id string, variant string, pred_doc_type string, seconds double, error string, fields map<string,string>")
    fields = metrics.scored_fields(records, truth)
    got = {r.variant: r.summary for r in metrics.summary(metrics.score(fields), metrics.accuracy_cube(fields), metrics.robustness(fields)).collect()}
    assert '"per_key":{"year":1.0}' in got["clean"] and '"per_doc_type":{"pts":0.0}' in got["blur:2"] and '"level":2' in got[None]


def test_too_many_variants_are_refused(spark, monkeypatch):
    monkeypatch.setattr(metrics, "MOST_VARIANTS", 2)
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "variant string")
    items = spark.createDataFrame([("1",)], "id string")
    with pytest.raises(ValueError):
        metrics.worklist(items, names, names.select(F.lit("1").alias("id"), "variant"))
