import random

import pytest

from pyspark.sql import functions as F

from dossia.functions import sql
from dossia.operators import joins
from dossia.plans import phrases as P
from dossia.plans import search_log as L
from dossia.plans.predicates import OPS, Cond, explain, search, vocabulary

CARDS = [
    (1, "HYUNDAI CRETA", 2016, 123, "БЕЛЫЙ", "МОРОЗОВА", "Г. САРАТОВ", "САРАТОВСКАЯ ОБЛ", "А123ВС164", "63ОХ123456"),
    (2, "LADA VESTA", 2019, 106, "ЧЕРНЫЙ", "ИВАНОВ", "Г. КАЗАНЬ", "РЕСП. ТАТАРСТАН", "В777ОР16", "164301000000001"),
    (3, "KIA RIO", 2012, 100, "СЕРЫЙ", "ИВАНОВА", None, None, None, None),
]
SCHEMA = "id int, make_model string, year int, power_hp int, color string, owner_last string, city string, region string, plate string, pts_number string"


@pytest.fixture(scope="module")
def cards(spark):
    return spark.createDataFrame(CARDS, SCHEMA)


def parsed(spark, cards, text):
    return P.conditions(P.parse_phrases(spark.createDataFrame([(1, text)], "phrase_id int, text string"), cards))


@pytest.mark.parametrize(
    ("text", "want", "rest"),
    [
        ("белые машины с 2015 по 2018 года", {("year", "between", ("2015", "2018")), ("color", "=", "БЕЛЫЙ")}, []),
        ("не старше 2012", {("year", ">=", "2012")}, []),
        ("до 2014 года мощнее 120 л.с.", {("year", "<", "2014"), ("power_hp", ">", "120")}, []),
        ("хендай крета", {("make_model", "like", "CRETA")}, []),
        ("Морозовой из Саратова", {("owner_last", "=", "МОРОЗОВА"), ("city", "like", "САРАТО")}, []),
        ("Иванова", {("owner_last", "=", "ИВАНОВА"), ("owner_last", "=", "ИВАНОВ")}, []),
        ("дизель 1.6 с электронным птс евро 5", {("engine_type", "like", "ДИЗЕЛ"), ("engine_volume", "between", ("1540", "1660")), ("pts_number", "len", "15"), ("eco_class", "=", "ПЯТЫЙ")}, []),
        ("а123вс164", {("plate", "=", "А123ВС164")}, []),
        ("номер 777", {("plate", "like", "777")}, []),
        ("vin xta2112", {("vin", "like", "XTA2112")}, []),
        ("категории b", {("category", "=", "B")}, []),
        ("тоёта", {("make_model", "like", "TOYOTA")}, []),
        ("абракадабра", set(), ["абракадабра"]),
        ("", set(), []),
    ],
)
def test_phrases(spark, cards, text, want, rest):
    conds, words = parsed(spark, cards, text)
    assert {(c.column, c.op, c.value) for c in conds} == want and words == rest


def test_year_at_a_words_end_is_part_of_the_word(spark, cards):
    assert parsed(spark, cards, "абракадабра1916") == ([], ["абракадабра1916"])
    conds, words = parsed(spark, cards, "белые 2015, 2016 г.")
    assert [(c.column, c.value) for c in conds] == [("year", "2015"), ("year", "2016"), ("color", "БЕЛЫЙ")] and words == []


def test_year_at_a_words_end_by_the_sql_function(spark):
    sql.register_phrases(spark, "x_phrase_conditions")
    got = spark.sql("SELECT p.t, c.value[0] AS v FROM VALUES ('абракадабра1916'), ('год 1916') AS p(t), LATERAL x_phrase_conditions(p.t) c").collect()
    assert [tuple(r) for r in got] == [("год 1916", "1916")]


def test_search(spark, cards):
    ids = lambda conds, words=(): [r.id for r in search(cards, conds, words).collect()]
    assert ids([Cond("color", "=", "БЕЛЫЙ"), Cond("color", "=", "СЕРЫЙ"), Cond("year", ">", "2010")]) == [1, 3]
    assert ids([Cond("pts_number", "len", 10), Cond("pts_number", "len", 15)]) == []
    assert ids([Cond("nothing", "=", 1)]) == [1, 2, 3] and ids([Cond("year", "=", "x")]) == []
    assert ids([Cond("city|region", "like", "татар")]) == [2] and ids([], ["казань", "lada"]) == [2]
    assert ids([Cond("owner_last", "=", "'; DROP TABLE vehicles; --")]) == [] and ids([Cond("make_model", "like", "%")]) == []
    assert {r.color for r in vocabulary(cards, "color").collect()} == {"БЕЛЫЙ", "ЧЕРНЫЙ", "СЕРЫЙ"}
    with pytest.raises(ValueError):
        vocabulary(cards, "x; --")


def test_models_imply_brands_without_cards(spark):
    conds, words = P.conditions(P.parse_phrases(spark.createDataFrame([(1, "хендай крета не старше 2015, киа")], "phrase_id int, text string")))
    assert {(c.column, c.value) for c in conds} == {("year", "2015"), ("make_model", "CRETA"), ("make_model", "KIA")} and words == []
    assert explain(conds[:1], {"year": "Год"}) == ["Год ≥ 2015"] and explain([Cond("year", "between", (1, 2))]) == ["year: 1–2"]


def test_phrase_finds_cards(spark, cards):
    conds, words = parsed(spark, cards, "белая крета Морозовой")
    assert [r.id for r in search(cards, conds, words).collect()] == [1]


def test_log_finds_what_single_searches_find(spark):
    """Random conditions of all kinds: the batch and one search after another agree, by the same limit."""
    rng = random.Random(11)
    makes, cities = ["KIA RIO", "KIA CEED", "LADA VESTA", "Ваз 2110", None, "", "%_"], ["САРАТОВ", "Казань", None]
    cards = [(n, rng.choice(makes), rng.choice(cities), rng.choice([None, -5, 0, *range(1990, 2024)]), rng.choice([None, 70, 100, 2**31 - 1, -(2**31)])) for n in rng.sample(range(1000), 300)]
    table = spark.createDataFrame(cards, "id int, make string, city string, year int, hp int")
    values = {"make": ["KIA RIO", "KIA", "kia c", "А", "Ваз 2110", "%", "none such long value"], "city": ["САРАТОВ", "аза", "К"], "year": ["2000", "02010", "1995", "x", "-5"], "hp": ["70", "100", "99", "2147483647"]}
    log, conds = [], {}
    for phrase in range(120):
        log.append((phrase,))
        conds[phrase] = []
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            column = rng.choice(["make", "city", "year", "hp", "make|city", "nothing"])
            op = rng.choice(OPS)
            pool = values[column.split("|")[0]] if column != "nothing" else ["1"]
            if op == "len":
                value = str(rng.choice([4, 7, 8]))
            elif op == "between":
                value = tuple(rng.choices(pool, k=2))
            else:
                value = rng.choice(pool)
            conds[phrase].append(Cond(column, op, value))
    rows = [(p, n, c.column, c.op, list(c.value) if c.op == "between" else [c.value]) for p, cs in conds.items() for n, c in enumerate(cs)]
    rows += [(200, 0, None, None, ["lada"]), (200, 1, None, None, ["каз"]), (201, 0, None, None, ["none such"])]
    parsed = spark.createDataFrame(rows, "phrase_id int, pos int, column string, op string, value array<string>")
    phrases = spark.createDataFrame([*log, (200,), (201,)], "phrase_id int")
    found = L.search_log(parsed, phrases, table, limit=15)
    assert "Cartesian" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    got = {}
    for r in found.orderBy("phrase_id", "rank").collect():
        got.setdefault(r.phrase_id, []).append(r.card)
    local = table.cache()
    for phrase, cs in conds.items():
        assert got.get(phrase, []) == [r.id for r in search(local, cs, limit=15).collect()], cs
    assert got.get(200, []) == [r.id for r in search(local, [], ["lada", "каз"], limit=15).collect()] and 201 not in got


def test_dyadic_intervals_cover_each_number_once(spark):
    rng = random.Random(3)
    rows = [(n, *sorted(rng.choices([0, 1, 2**L.BITS - 1, *[rng.randrange(2**L.BITS) for _ in range(3)]], k=2)), rng.randrange(2**L.BITS)) for n in range(300)]
    df = spark.createDataFrame([(*r[:3], x) for r in rows for x in (r[3], r[1], r[2], max(0, r[1] - 1), r[2] + 1)], "n int, low long, high long, x long").where(f"x < {2**L.BITS}")
    hits = F.size(F.array_intersect(L._cover(F.col("low"), F.col("high")), L._ancestors(F.col("x"))))
    bad = df.withColumn("hits", hits).where((F.col("hits") != F.col("x").between(F.col("low"), F.col("high")).cast("int")))
    assert bad.count() == 0


def test_empty_log_and_table(spark, cards):
    parsed = P.parse_phrases(spark.createDataFrame([(1, "белые"), (2, ""), (3, None)], "phrase_id int, text string"), cards)
    log = spark.createDataFrame([(1,), (2,), (3,)], "phrase_id int")
    assert sorted((r.phrase_id, r.card) for r in L.search_log(parsed, log, cards, limit=2).collect()) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2)]
    assert L.search_log(parsed, log, cards.limit(0)).collect() == [] and L.search_log(parsed.limit(0), log.limit(0), cards).collect() == []


def test_search_log_broadcasts_only_what_was_counted(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    tests = [("year", ">=", ["2001"]), ("year", "between", ["1999", "2002"]), ("vin", "like", ["A9"]), ("vin", "len", ["2"]), ("vin", "=", ["A7"])]
    tests = spark.createDataFrame(tests, "column string, op string, value array<string>")
    values = spark.createDataFrame([("year", str(1990 + k)) for k in range(20)] + [("vin", f"A{k}") for k in range(20)], "column string, held string")
    matching = L.matching_values(tests, values, ["year"])
    assert "Broadcast" not in matching._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in matching.collect():
        got.setdefault((r.column, r.op), set()).add(r.held)
    years = lambda a, b: {str(y) for y in range(a, b)}
    want = {("year", ">="): years(2001, 2010), ("year", "between"): years(1999, 2003), ("vin", "like"): {"A9"}, ("vin", "len"): {f"A{k}" for k in range(10)}, ("vin", "="): {"A7"}}
    assert got == want
