from pyspark.sql import functions as F

from dossia.functions.canon import vin_check_digit
from dossia.operators import quality
from dossia.operators.checkpoints import cut
from dossia.schema import DOC_FIELDS
from dossia.sources import generate


def test_documents_have_exactly_their_fields_and_pass_all_checks(spark):
    docs = generate.documents(generate.vehicles(spark, 400, seed=11)).withColumn("checks", quality.checks(F.col("doc_type"), F.col("fields"), 2026)).withColumn("keys", F.map_keys("fields")).collect()
    assert len(docs) == 1200 and {r.doc_type for r in docs} == set(DOC_FIELDS)
    for r in docs:
        assert r["keys"] == DOC_FIELDS[r.doc_type] and all(r.fields.values())
        assert not [c for c in r.checks if c.level in ("warn", "error")], (r.fields, r.checks)


def test_vehicles_dont_depend_on_each_other(spark):
    few = {r.vehicle_id: r for r in generate.vehicles(spark, 50, seed=5).collect()}
    many = {r.vehicle_id: r for r in generate.vehicles(spark, 2000, seed=5).repartition(7).collect()}
    assert all(many[k] == r for k, r in few.items()) and len({r.vin for r in many.values()}) == 2000
    other = {r.vehicle_id: r for r in generate.vehicles(spark, 50, seed=6).collect()}
    assert sum(other[k].color == r.color for k, r in few.items()) < 40


def test_shares_follow_the_weights(spark):
    cars = cut(generate.vehicles(spark, 20_000))
    shares = {r.color: r["count"] / 20_000 for r in cars.groupBy("color").count().collect()}
    total = sum(generate.COLORS.values())
    assert shares.keys() == generate.COLORS.keys() and all(abs(shares[c] - w / total) < 0.015 for c, w in generate.COLORS.items())
    assert cars.select("make_model").distinct().count() == len(generate.MODELS)
    right = cars.where(vin_check_digit(F.col("vin")) == F.substring("vin", 9, 1)).count() / 20_000
    assert 0.6 < right < 0.7 and cars.where("pts_kind = 'epts' and cast(year as int) < 2019").count() == 0
