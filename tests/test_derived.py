import os
from collections import Counter

import duckdb
import pytest

from dossia.operators import layout
from dossia.plans import catalog, derived  # noqa: F401

NAMES = ["nlq_parse", "nlq_model_answers", "quality_documents", "document_words", "store_round_trip", "fold_cards_agreeing", "layout_fields", "layout_passports", "quality_messages", "quality_level_counts", "lcs_ratio", "record_log", "nlq_conjunction"]


@pytest.fixture(scope="module")
def small():
    return os.environ.get("TEST_SMALL_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for name in ("customer", "orders", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql(spark, small, sql, name):
    df = catalog.QUERIES[name](spark, small)
    want = sql.execute(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(d[0] for d in want.description)
    rows = Counter(tuple(r) for r in df.select(*[d[0] for d in want.description]).collect())
    assert rows and rows == Counter(want.fetchall())


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for n, y in enumerate(b, 1):
            last, row[n] = row[n], last + 1 if x == y else max(row[n], row[n - 1])
    return row[-1]


@pytest.mark.parametrize(("a", "b"), [("год выпуска тс", "5 год изготовления тс"), ("aaaa", "aa"), ("ab" * 50, "ba" * 40), ("x", "y"), ("", "abc"), ("цвет", "цвет кузова" * 9)])
def test_bitwise_lcs(a, b):
    assert layout.lcs_ratio(a, b) == pytest.approx(200 * plain_lcs(a, b) / (len(a) + len(b)))


def test_near_labels_of_odd_lines(spark):
    lines = spark.createDataFrame([("цвет",), ("цвет",), ("",), (None,), ("щ" * 5000,)], "label string")
    near = {r.label: {(x.doc_type, x.key) for x in r.near} for r in layout.near_labels(lines, 80).collect()}
    assert near == {"цвет": {("sts_front", "color"), ("epts", "color")}}
    assert layout.near_labels(lines.limit(0), 80).collect() == []


def test_model_answers_of_odd_rows(spark):
    from dossia.plans.phrases import model_conditions

    rows = [(1, None), (2, ""), (3, "{broken"), (4, '{"conditions": []}'), (5, '<think>{"a": 1}</think>{"conditions": [{"column": "year", "op": ">", "value": 2015}]}'), (5, '{"conditions": [{"column": "year", "op": "between", "value": [1]}]}')]
    got = model_conditions(spark.createDataFrame(rows, "phrase_id int, answer string")).collect()
    assert [(r.phrase_id, r.column, r.op, r.value) for r in got] == [(5, "year", ">", ["2015"])]
