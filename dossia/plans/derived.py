"""Queries over document-like rows that are derived from keys: phrases, findings, cards and printed pages. The SQL states what must come out of each row."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.functions import canon as C
from dossia.functions import sql
from dossia.operators import layout, linking, quality
from dossia.operators.checkpoints import shared_dir
from dossia.plans.catalog import query, table
from dossia.plans.phrases import model_conditions, parse_phrases
from dossia.plans.search_log import search_log
from dossia.schema import CARD_COLUMNS, CARD_INTEGERS, EPTS, PTS, STS_BACK, STS_FRONT
from dossia.sources.labels import decode_documents, encode_documents
from dossia.sources.store import add_batch, look_up


def _pick(number: Column, values: list) -> Column:
    """The value at a number, from 0 on."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (number + 1).cast("int"))


def _padded(number: Column, size: int) -> Column:
    return F.lpad(number.cast("string"), size, "0")


def _map(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


# ---- phrases ------------------------------------------------------------------------------------------------------


def _phrases(customers: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    year, hp = (k % 30 + 1990).cast("string"), (k % 200 + 50).cast("string")
    later = (k % 30 + 1990 + k % 5).cast("string")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    texts = [
        say("с ", year, " по ", later, " года"), say(year, "-", later), say("не старше ", year, " года"), say("новее ", year), say("до ", year, " года"), say("от ", year, " г."),
        say(year, " года"), say("мощнее ", hp, " л.с."), say("слабее ", hp, " сил"), say(hp, " лс"), say((k % 4 + 1).cast("string"), ",", (k % 10).cast("string"), " л"), "Дизельные",
        "бензиновый", "с ЭПТС", "с бумажным ПТС", "Евро 5", "экокласс четвертый", say("а", _padded(k % 1000, 3), "вс", (k % 90 + 10).cast("string")), say("номер ", (k % 7 + 1).cast("string"), "45"),
        say("xta21129", _padded(k, 9)), say("vin xta2112", (k % 10).cast("string")), _pick(k % 4, ["белые машины", "чёрные", "синие", "цвет красный"]),
        _pick(k % 3, ["тойоту", "фольксваген", "киа!"]), say("zx", (k % 40).cast("string")), "категории b", _pick(k % 2, ["машины Морозовой", "Петровым"]), "из Саратова", "татарстан",
        say("абракадабра", k.cast("string")), say("киа zx", (k % 40).cast("string")), say("белые киа не старше ", year, " года из саратова"), F.when(k % 3 == 0, ""),
    ]
    return customers.select(k.alias("phrase_id"), _pick(k % len(texts), texts).alias("text"))


def _phrase_cards(customers: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customers.select(
        F.concat(F.lit("KIA ZX"), (k % 40).cast("string")).alias("make_model"), _pick(k % 4, ["МОРОЗОВА", "ИВАНОВ", "ПЕТРОВ", "СОКОЛОВА"]).alias("owner_last"),
        F.when(k % 3 != 0, "Г. САРАТОВ").alias("city"), F.when(k % 2 == 0, "РЕСП. ТАТАРСТАН").alias("region"),
    )


_CONDITIONS = """
    WITH p AS (SELECT c_custkey AS k, c_custkey % 32 AS t, CAST(1990 + c_custkey % 30 AS VARCHAR) AS y, CAST(1990 + c_custkey % 30 + c_custkey % 5 AS VARCHAR) AS z, CAST(50 + c_custkey % 200 AS VARCHAR) AS h,
                      1000 * (1 + c_custkey % 4) + 100 * (c_custkey % 10) AS ccm FROM customer)
    SELECT k AS phrase_id, 'year' AS "column", 'between' AS op, y || '|' || z AS value FROM p WHERE t IN (0, 1)
    UNION ALL SELECT k, 'year', CASE t WHEN 3 THEN '>' WHEN 4 THEN '<' WHEN 6 THEN '=' ELSE '>=' END, y FROM p WHERE t IN (2, 3, 4, 5, 6, 30)
    UNION ALL SELECT k, 'power_hp', CASE t WHEN 7 THEN '>' WHEN 8 THEN '<' ELSE '=' END, h FROM p WHERE t IN (7, 8, 9)
    UNION ALL SELECT k, 'engine_volume', 'between', CAST(ccm - 60 AS VARCHAR) || '|' || CAST(ccm + 60 AS VARCHAR) FROM p WHERE t = 10
    UNION ALL SELECT k, 'engine_type', 'like', CASE t WHEN 11 THEN 'ДИЗЕЛ' ELSE 'БЕНЗИН' END FROM p WHERE t IN (11, 12)
    UNION ALL SELECT k, 'pts_number', 'len', CASE t WHEN 13 THEN '15' ELSE '10' END FROM p WHERE t IN (13, 14)
    UNION ALL SELECT k, 'eco_class', '=', CASE t WHEN 15 THEN 'ПЯТЫЙ' ELSE 'ЧЕТВЕРТЫЙ' END FROM p WHERE t IN (15, 16)
    UNION ALL SELECT k, 'plate', '=', 'А' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || 'ВС' || CAST(10 + k % 90 AS VARCHAR) FROM p WHERE t = 17
    UNION ALL SELECT k, 'plate', 'like', CAST(1 + k % 7 AS VARCHAR) || '45' FROM p WHERE t = 18
    UNION ALL SELECT k, 'vin', '=', 'XTA21129' || lpad(CAST(k AS VARCHAR), 9, '0') FROM p WHERE t = 19
    UNION ALL SELECT k, 'vin', 'like', 'XTA2112' || CAST(k % 10 AS VARCHAR) FROM p WHERE t = 20
    UNION ALL SELECT k, 'color', '=', CASE k % 4 WHEN 0 THEN 'БЕЛЫЙ' WHEN 1 THEN 'ЧЕРНЫЙ' WHEN 2 THEN 'СИНИЙ' ELSE 'КРАСНЫЙ' END FROM p WHERE t = 21
    UNION ALL SELECT k, 'color', '=', 'БЕЛЫЙ' FROM p WHERE t = 30
    UNION ALL SELECT k, 'make_model', 'like', CASE k % 3 WHEN 0 THEN 'TOYOTA' WHEN 1 THEN 'VOLKSWAGEN' ELSE 'KIA' END FROM p WHERE t = 22
    UNION ALL SELECT k, 'make_model', 'like', 'KIA' FROM p WHERE t = 30
    UNION ALL SELECT k, 'make_model', 'like', 'ZX' || CAST(k % 40 AS VARCHAR) FROM p WHERE t IN (23, 29)
    UNION ALL SELECT k, 'category', '=', 'B' FROM p WHERE t = 24
    UNION ALL SELECT k, 'owner_last', '=', CASE k % 2 WHEN 0 THEN 'МОРОЗОВА' ELSE 'ПЕТРОВ' END FROM p WHERE t = 25
    UNION ALL SELECT k, 'city', 'like', 'САРАТО' FROM p WHERE t IN (26, 30)
    UNION ALL SELECT k, 'region', 'like', 'ТАТАРСТ' FROM p WHERE t = 27
    UNION ALL SELECT k, NULL, NULL, 'абракадабра' || CAST(k AS VARCHAR) FROM p WHERE t = 28"""


@query(_CONDITIONS)
def nlq_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of a phrase from each customer, one of 32 kinds, against cards from all customers."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return parse_phrases(_phrases(customers), _phrase_cards(customers)).select("phrase_id", "column", "op", F.array_join("value", "|").alias("value"))


@query(f"""
    SELECT phrase_id, "column", op, value FROM ({_CONDITIONS})
    WHERE "column" IN ('year', 'power_hp', 'engine_volume', 'engine_type', 'pts_number', 'eco_class', 'plate') OR "column" = 'vin'""")
def sql_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules find in phrases, by a table function in SQL."""
    sql.register_phrases(spark)
    _phrases(table(spark, sf_dir, "customer").select("c_custkey")).createOrReplaceTempView("phrases_of_customers")
    return spark.sql("SELECT p.phrase_id, c.`column`, c.op, array_join(c.value, '|') AS value FROM phrases_of_customers p, LATERAL phrase_conditions(p.text) c")


@query("""
    SELECT p_partkey, 'XTA' || lpad(CAST(p_partkey AS VARCHAR), 14, '0') AS vin, CAST(p_partkey % 28 + p_size AS VARCHAR) AS number, least(1.0, CAST(levenshtein(upper(p_brand), upper(p_type)) AS DOUBLE) / length(p_type)) AS cer,
           CASE WHEN p_partkey % 3 = 0 THEN '—' ELSE CAST(p_partkey % 101 AS VARCHAR) || '.0%' END AS share
    FROM part""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical forms, error rates and shares by functions in SQL alone."""
    sql.register(spark)
    return spark.sql(
        f"""SELECT p_partkey, canon_vin(concat('хта ', lpad(CAST(p_partkey AS STRING), 14, 'O'))) AS vin, canon_year(concat('000', p_partkey % 28 + p_size, ' г.')) AS number, cer(upper(p_brand), upper(p_type)) AS cer,
                   percent_text(CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 101 / 100 END) AS share
            FROM parquet.`{sf_dir}/part.parquet`"""
    )


_COLORS = ["БЕЛЫЙ", "ЧЕРНЫЙ", "СИНИЙ", "КРАСНЫЙ"]


def _log_cards(customers: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customers.select(
        k.alias("id"), F.concat(_pick(k % 3, ["KIA", "TOYOTA", "VOLKSWAGEN"]), F.lit(" ZX"), (k % 40).cast("string")).alias("make_model"),
        _pick(k % 4, ["МОРОЗОВА", "ИВАНОВ", "ПЕТРОВ", "СОКОЛОВА"]).alias("owner_last"), F.when(k % 3 != 0, "Г. САРАТОВ").alias("city"),
        F.when(k % 2 == 0, "РЕСП. ТАТАРСТАН").alias("region"), F.when(k % 11 != 0, k % 30 + 1990).cast("int").alias("year"), (k % 200 + 50).cast("int").alias("power_hp"),
        (k % 4 * 1000 + k % 10 * 100 + 1010).cast("int").alias("engine_volume"), _pick(k % 2, ["ДИЗЕЛЬНЫЙ", "Бензиновый"]).alias("engine_type"),
        F.when(k % 2 == 0, _padded(k, 15)).otherwise(_padded(k, 10)).alias("pts_number"), _pick(k % 3, ["ПЯТЫЙ", "ЧЕТВЕРТЫЙ", F.lit(None).cast("string")]).alias("eco_class"),
        F.concat(F.lit("А"), _padded(k % 1000, 3), F.lit("ВС"), (k % 90 + 10).cast("string")).alias("plate"), F.concat(F.lit("XTA21129"), _padded(k, 9)).alias("vin"),
        _pick(k % 4, _COLORS).alias("color"), F.when(k % 2 == 0, "B").alias("category"),
    )


@query(f"""
    WITH conds AS ({_CONDITIONS}),
    cards AS (
        SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'KIA' WHEN 1 THEN 'TOYOTA' ELSE 'VOLKSWAGEN' END || ' ZX' || CAST(c_custkey % 40 AS VARCHAR) AS make_model,
               CASE c_custkey % 4 WHEN 0 THEN 'МОРОЗОВА' WHEN 1 THEN 'ИВАНОВ' WHEN 2 THEN 'ПЕТРОВ' ELSE 'СОКОЛОВА' END AS owner_last,
               CASE WHEN c_custkey % 3 <> 0 THEN 'Г. САРАТОВ' END AS city, CASE WHEN c_custkey % 2 = 0 THEN 'РЕСП. ТАТАРСТАН' END AS region,
               CASE WHEN c_custkey % 11 <> 0 THEN 1990 + c_custkey % 30 END AS year, 50 + c_custkey % 200 AS power_hp, 1010 + 1000 * (c_custkey % 4) + 100 * (c_custkey % 10) AS engine_volume,
               CASE c_custkey % 2 WHEN 0 THEN 'ДИЗЕЛЬНЫЙ' ELSE 'БЕНЗИНОВЫЙ' END AS engine_type, CASE WHEN c_custkey % 2 = 0 THEN 15 ELSE 10 END AS pts_size,
               CASE c_custkey % 3 WHEN 0 THEN 'ПЯТЫЙ' WHEN 1 THEN 'ЧЕТВЕРТЫЙ' END AS eco_class,
               'А' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || 'ВС' || CAST(10 + c_custkey % 90 AS VARCHAR) AS plate, 'XTA21129' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS vin,
               CASE c_custkey % 4 WHEN 0 THEN 'БЕЛЫЙ' WHEN 1 THEN 'ЧЕРНЫЙ' WHEN 2 THEN 'СИНИЙ' ELSE 'КРАСНЫЙ' END AS color, CASE WHEN c_custkey % 2 = 0 THEN 'B' END AS category
        FROM customer
    ), met AS (
        SELECT phrase_id, id, "column", op, CASE
            WHEN "column" IN ('year', 'power_hp', 'engine_volume') THEN (CASE op
                WHEN 'between' THEN number BETWEEN CAST(split_part(value, '|', 1) AS INT) AND CAST(split_part(value, '|', 2) AS INT)
                WHEN '=' THEN number = CAST(value AS INT) WHEN '<' THEN number < CAST(value AS INT) WHEN '>' THEN number > CAST(value AS INT) ELSE number >= CAST(value AS INT) END)
            WHEN op = 'len' THEN pts_size = CAST(value AS INT)
            WHEN op = 'like' THEN contains(held, value) ELSE held = value END AS ok
        FROM (SELECT phrase_id, "column", op, value, id, pts_size, CASE "column" WHEN 'year' THEN year WHEN 'power_hp' THEN power_hp ELSE engine_volume END AS number,
                     CASE "column" WHEN 'make_model' THEN make_model WHEN 'owner_last' THEN owner_last WHEN 'city' THEN city WHEN 'region' THEN region WHEN 'engine_type' THEN engine_type
                                   WHEN 'eco_class' THEN eco_class WHEN 'plate' THEN plate WHEN 'vin' THEN vin WHEN 'color' THEN color WHEN 'category' THEN category END AS held
              FROM conds, cards WHERE "column" IS NOT NULL)
    ), units AS (SELECT phrase_id, id, "column", op, bool_or(coalesce(ok, false)) AS ok FROM met GROUP BY phrase_id, id, "column", op),
    found AS (
        SELECT phrase_id, id FROM units GROUP BY phrase_id, id HAVING bool_and(ok)
        UNION ALL SELECT c_custkey, id FROM customer, cards WHERE c_custkey NOT IN (SELECT phrase_id FROM conds)
    ), ranked AS (SELECT phrase_id, CAST(row_number() OVER (PARTITION BY phrase_id ORDER BY id) AS INTEGER) AS rank, id AS card FROM found)
    SELECT phrase_id, rank, card FROM ranked WHERE rank <= 20""")
def nlq_search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 cards (the feature: the first n by id) of a phrase from each customer, all phrases searched at once."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    phrases, cards = _phrases(customers), _log_cards(customers)
    return search_log(parse_phrases(phrases, cards), phrases, cards, limit=20)


@query("""
    SELECT c_custkey AS phrase_id, 'year' AS "column", 'between' AS op, '2001|' || CAST(2002 + c_custkey % 9 AS VARCHAR) AS value FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT c_custkey, 'color', '=', 'БЕЛЫЙ' FROM customer WHERE c_custkey % 3 = 1""")
def nlq_model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that a model answered, those outside of the white list left out."""
    last = (F.col("c_custkey") % 9 + 2002).cast("string")
    between = F.concat(F.lit('{"column": "year", "op": "BETWEEN", "value": [2001, '), last, F.lit("]}"))
    wrong = '{"column": "year", "op": "between", "value": 7}, {"column": "vin", "op": "len", "value": 17}, {"column": "x; --", "op": "=", "value": 1}, {"column": "year", "op": "~", "value": 1}'
    some = F.concat(F.lit('```json\n{"conditions": ['), between, F.when(F.col("c_custkey") % 3 == 1, ', {"column": "color", "op": "=", "value": "БЕЛЫЙ"}').otherwise(""), F.lit(f", {wrong}]}}\n```"))
    answer = F.when(F.col("c_custkey") % 3 == 0, "no idea").otherwise(some)
    found = model_conditions(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("phrase_id"), answer.alias("answer")))
    return found.select("phrase_id", "column", "op", F.array_join("value", "|").alias("value"))


# ---- findings -----------------------------------------------------------------------------------------------------

_DIGIT = " + ".join(
    f"{w} * coalesce(CAST(nullif(translate(substr(vin, {n + 1}, 1), '{''.join(C.VIN_VALUES)}', '{''.join(map(str, C.VIN_VALUES.values()))}'), '') AS INTEGER), 0)" for n, w in enumerate(C.VIN_WEIGHTS) if w
)


@query(f"""
    WITH k AS (SELECT o_orderkey AS k, o_orderkey % 3 AS t, 2010 + o_orderkey % 4 AS year,
                      CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'XTA' || CAST(o_orderkey AS VARCHAR)
                           ELSE 'XTA211290' || substr('BC', CAST(1 + o_orderkey % 2 AS BIGINT), 1) || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') END AS vin FROM orders),
    d AS (SELECT *, {_DIGIT} AS total, vin IS NOT NULL AND k % 5 <> 0 AS good, substr('ABCD', CAST(year - 2009 AS BIGINT), 1) AS code, substr(vin, 10, 1) AS place,
                 'А' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || 'ВС' AS plate FROM k)
    SELECT k AS o_orderkey, 'ok' AS level, 'vin' AS field, 'VIN записан правильно' AS message FROM d WHERE good
    UNION ALL SELECT k, 'error', 'vin', 'Значение «' || vin || '» не может быть VIN (17 латинских букв и цифр, кроме I, O и Q)' FROM d WHERE vin IS NOT NULL AND NOT good
    UNION ALL SELECT k, 'info', 'vin', 'Контрольная цифра VIN (место 9) не сходится; вне Северной Америки её могут не ставить' FROM d WHERE good AND total % 11 <> 0
    UNION ALL SELECT k, 'ok', 'year', 'VIN и год выпуска согласуются' FROM d WHERE good AND code = place
    UNION ALL SELECT k, 'warn', 'year', 'В VIN на месте 10 стоит «' || place || '», это не ' || CAST(year AS VARCHAR) || ' год' FROM d WHERE good AND code <> place
    UNION ALL SELECT k, 'warn', 'body', 'VIN и номер кузова разные' FROM d WHERE vin IS NOT NULL AND t = 2
    UNION ALL SELECT k, 'ok', 'plate', 'Номер записан правильно, код региона 64: САРАТОВСКАЯ ОБЛ' FROM d WHERE k % 4 = 0
    UNION ALL SELECT k, 'error', 'plate', 'Значение «А12» не может быть номером машины' FROM d WHERE k % 4 = 1
    UNION ALL SELECT k, 'ok', 'plate', 'Номер записан правильно, код региона 00' FROM d WHERE k % 4 = 2
    UNION ALL SELECT k, 'warn', 'pts_number', 'Это не номер паспорта машины, ни бумажного, ни электронного' FROM d WHERE k % 6 = 2
    UNION ALL SELECT k, 'warn', 'owner_last', '«Фамилия собственника»: не только русские буквы' FROM d WHERE k % 5 = 1
    UNION ALL SELECT k, 'error', 'issue_date', 'В дате выдачи нет дня, месяца и года' FROM d WHERE k % 9 = 0
    UNION ALL SELECT k, 'ok', 'doc_number', 'Номер записан правильно' FROM d WHERE k % 8 <> 0
    UNION ALL SELECT k, 'error', 'doc_number', 'Значение «12» не может быть номером: ' || CASE t WHEN 0 THEN 'нужно 10 цифр' WHEN 1 THEN 'нужны две цифры, две буквы и шесть цифр' ELSE 'нужно 15 цифр' END FROM d WHERE k % 8 = 0""")
def quality_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their messages on identifiers, dates and names of a document from each order."""
    k = F.col("o_orderkey")
    vin = F.when(k % 7 == 0, None).when(k % 5 == 0, F.concat(F.lit("xta"), k.cast("string"))).otherwise(F.concat(F.lit("ХТА 211290"), F.when(k % 2 == 0, "B").otherwise("C"), _padded(k, 7)))
    number = F.when(k % 8 == 0, "12").otherwise(_pick(k % 3, [F.concat(F.lit("99 21 № "), _padded(k % 1000000, 6)), F.concat(F.lit("63 OX "), _padded(k % 1000000, 6)), F.concat(F.lit("16430"), _padded(k, 10))]))
    plate = F.concat(F.lit("a"), _padded(k % 1000, 3), F.lit("bc"))
    values = {
        "vin": vin, "year": (k % 4 + 2010).cast("string"), "body": _pick(k % 3, [vin, "отсутствует", F.concat(F.lit("body "), k.cast("string"))]),
        "plate": _pick(k % 4, [F.concat(plate, F.lit("64")), "A12", F.concat(plate, F.lit("|00")), F.lit(None).cast("string")]), "doc_number": number,
        "pts_number": _pick(k % 6, ["63ox123456", "164301000000001", "12", "", "нет данных", F.lit(None).cast("string")]), "owner_last": _pick(k % 5, ["Иванов", "IVANOV1", "ИВАНОВ-ПЕТРОВ", "", "Ёлкин"]),
        "issue_date": F.when(k % 9 == 0, "без даты").otherwise("01.02.2020"),
    }
    kind = _pick(k % 3, [STS_FRONT, PTS, EPTS])
    rows = quality.with_checks(table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("doc_type"), _map(values).alias("fields")), 2025)
    return quality.findings(rows, "o_orderkey")


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'owner_last,owner_first,owner_middle,region,street_address,gibdd_code,issue_date'
                           ELSE 'owner_last,owner_first,owner_middle,region,city,street_address,gibdd_code,issue_date' END AS missing,
           CASE WHEN c_custkey % 30 BETWEEN 1 AND 9 THEN CAST(c_custkey % 30 AS VARCHAR) WHEN c_custkey % 30 >= 10 THEN substr('ABCDEFGHJKLMNPRSTVWXY', CAST(c_custkey % 30 - 9 AS BIGINT), 1) END AS year_code,
           CASE WHEN c_custkey % 9 = 0 THEN '—' ELSE CAST(c_custkey % 101 AS VARCHAR) || '.0%' END AS share
    FROM customer""")
def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing fields, model year characters and shares as text."""
    k = F.col("c_custkey")
    fields = _map({"doc_number": k.cast("string"), "city": F.when(k % 2 == 0, "X").otherwise(""), "region": F.lit(None).cast("string")})
    share = F.when(k % 9 != 0, (k % 101) / 100)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(quality.missing_fields(F.lit(STS_BACK), fields), ",").alias("missing"), C.vin_year_code(k % 30 + 2000).alias("year_code"), C.percent_text(share).alias("share")
    )


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END AS n_fields,
           CASE WHEN c_custkey % 5 = 0 THEN 'warn' END AS level, CASE WHEN c_custkey % 5 = 0 THEN 'в "кавычках"' END AS message FROM customer""")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and findings through their stored JSON form and back."""
    k = F.col("c_custkey")
    finding = F.struct(F.lit("warn").alias("level"), F.lit("vin").alias("field"), F.lit('в "кавычках"').alias("message"))
    some = F.create_map(F.lit("owner_last"), F.col("c_name"))
    docs = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 4 == 0, F.create_map().cast("map<string,string>")).otherwise(some).alias("fields"), F.when(k % 5 == 0, F.array(finding)).otherwise(F.array().cast(quality.CHECK)).alias("checks")
    )
    back = decode_documents(encode_documents(docs))
    first = F.get("checks", 0)
    return back.select("c_custkey", F.element_at("fields", "owner_last").alias("name"), F.size("fields").alias("n_fields"), first["level"].alias("level"), first["message"].alias("message"))


# ---- cards --------------------------------------------------------------------------------------------------------


@query("""
    WITH d AS (SELECT o_orderkey AS seq, o_custkey AS c, o_orderkey % 3 AS t FROM orders),
    m AS (SELECT c, max(CASE WHEN t = 2 THEN 1 ELSE 0 END) AS met FROM d GROUP BY c),
    g AS (SELECT d.*, CASE WHEN m.met = 1 THEN 2 ELSE d.t END AS part FROM d JOIN m ON d.c = m.c)
    SELECT min(seq) AS first_seq, count(*) AS doc_count, CASE WHEN part <> 1 THEN 'XTA2112900' || lpad(CAST(c AS VARCHAR), 7, '0') END AS vin,
           CASE WHEN part <> 0 THEN '99' || lpad(CAST(c AS VARCHAR), 8, '0') END AS sts_number, max(CASE WHEN seq % 2 = 0 THEN 'COLOR ' || CAST(c % 9 AS VARCHAR) END) AS color,
           max(CASE WHEN seq % 5 = 0 THEN CAST(1990 + c % 30 AS INTEGER) END) AS year
    FROM g GROUP BY c, part""")
def fold_cards_agreeing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of documents that never contradict each other, so that the order of folding and merging can't be seen: those with only one key are joined by those with both."""
    seq, c = F.col("o_orderkey"), F.col("o_custkey")
    values = {
        "vin": F.when(seq % 3 != 1, F.concat(F.lit("xta2112900"), _padded(c, 7))), "doc_number": F.when(seq % 3 != 0, F.concat(F.lit("99 "), _padded(c, 8))),
        "color": F.when(seq % 2 == 0, F.concat(F.lit("COLOR "), (c % 9).cast("string"))), "year": F.when(seq % 5 == 0, (c % 30 + 1990).cast("string")),
    }
    docs = table(spark, sf_dir, "orders").select(seq.alias("seq"), *linking.card_values(F.lit(STS_FRONT), _map(values)))
    cards = linking.folded_cards(linking.link_documents(docs))
    return cards.select("first_seq", "doc_count", "vin", "sts_number", "color", "year")


@query("""
    WITH d AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS by_vin, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 END AS by_sts, o_custkey + 2 AS by_pts FROM orders)
    SELECT seq, coalesce(v.c_custkey, s.c_custkey, p.c_custkey) AS card
    FROM d LEFT JOIN customer v ON by_vin = v.c_custkey LEFT JOIN customer s ON by_sts = s.c_custkey LEFT JOIN customer p ON by_pts = p.c_custkey""")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored card of a document from each order, by vin, else by certificate, else by passport; cards are those of all customers."""
    k, o, c = F.col("c_custkey"), F.col("o_orderkey"), F.col("o_custkey")
    key = lambda kind, number: F.concat(F.lit(kind), number.cast("string"))
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    add_batch(spark, path, table(spark, sf_dir, "customer").select(k.alias("seq"), key("V", k).alias("vin"), key("S", k).alias("sts_number"), key("P", k).alias("pts_number")))
    vin = F.when(o % 3 == 0, key("V", c)).when(o % 3 == 1, "unknown")
    asked = table(spark, sf_dir, "orders").select(o.alias("seq"), vin.alias("vin"), F.when(o % 2 == 0, key("S", c + 1)).alias("sts_number"), key("P", c + 2).alias("pts_number"))
    return look_up(spark, path, asked)


@query("""
    WITH RECURSIVE d AS (
        SELECT c_nationkey AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, c_custkey AS seq,
               CASE WHEN c_custkey % 3 <> 0 THEN 'V' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(c_custkey * 7 % 11 AS VARCHAR) END AS vin,
               CASE WHEN c_custkey % 4 <> 0 THEN 'S' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(c_custkey * 5 % 13 AS VARCHAR) END AS sts,
               CASE WHEN c_custkey % 2 = 0 THEN 'COLOR ' || CAST(c_custkey % 9 AS VARCHAR) END AS color, CASE WHEN c_custkey % 5 = 0 THEN CAST(1990 + c_custkey % 30 AS INTEGER) END AS year
        FROM customer
    ), f(g, n, cards) AS (
        SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS STRUCT(card BIGINT, vin VARCHAR, sts VARCHAR, color VARCHAR, year INTEGER, doc_count BIGINT)[]) FROM d
        UNION ALL
        SELECT g, n, list_append([x FOR x IN cards IF x.card <> coalesce(t.card, -1) AND x.card <> coalesce(o.card, -1)], {
            'card': coalesce(t.card, seq), 'vin': coalesce(vin, t.vin, o.vin), 'sts': coalesce(sts, t.sts, o.sts), 'color': coalesce(color, t.color, o.color),
            'year': coalesce(year, t.year, o.year), 'doc_count': 1 + coalesce(t.doc_count, 0) + coalesce(o.doc_count, 0)})
        FROM (SELECT *, coalesce(a, b) AS t, CASE WHEN a.card <> b.card THEN b END AS o
              FROM (SELECT d.*, cards, [x FOR x IN cards IF x.vin = d.vin][1] AS a, [x FOR x IN cards IF x.sts = d.sts][1] AS b FROM f JOIN d ON d.g = f.g AND d.n = f.n + 1))
    ), last AS (SELECT unnest(cards) AS c FROM f WHERE (g, n) IN (SELECT g, max(n) FROM f GROUP BY g))
    SELECT c.card AS card, c.vin AS vin, c.sts AS sts_number, c.color AS color, c.year AS year, c.doc_count AS doc_count FROM last""")
def fold_cards_conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of documents that contradict each other: keys are overwritten, forgotten and met again, and cards merge, in each nation's log of customers."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    key = lambda kind, number: F.concat(F.lit(kind), nation, F.lit("-"), number.cast("string"))
    values = {
        "vin": F.when(k % 3 != 0, key("V", k * 7 % 11)), "sts_number": F.when(k % 4 != 0, key("S", k * 5 % 13)), "color": F.when(k % 2 == 0, F.concat(F.lit("COLOR "), (k % 9).cast("string"))),
        "year": F.when(k % 5 == 0, k % 30 + 1990).cast("int"),
    }
    docs = table(spark, sf_dir, "customer").select(k.alias("seq"), *[values.get(c, F.lit(None).cast("int" if c in CARD_INTEGERS else "string")).alias(c) for c in CARD_COLUMNS])
    return linking.folded_cards(linking.link_documents(docs)).select("card", "vin", "sts_number", "color", "year", "doc_count")


# ---- printed pages ------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with places of a registration certificate from each customer: its front for odd keys, its back for even ones."""
    k = F.col("c_custkey")
    word = lambda line, left, text: F.struct(F.lit(line).alias("line"), F.lit(left).alias("left"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))
    back = F.array(
        word(0, 0, "СОБСТВЕННИК (ВЛАДЕЛЕЦ)"), word(1, 0, "Фамилия"), word(1, 400, _pick(k % 3, ["ИВАНОВ", "ПЕТРОВА", "СИДОРОВ"])), word(1, 600, "мусор"), word(2, 0, "Населенный пункт"), word(2, 400, "Г."),
        word(2, 440, "САРАТОВ"), word(3, 0, "Дата выдачи"), word(3, 400, F.concat(F.lit("01.02."), (k % 30 + 1990).cast("string"))), word(4, 400, F.concat(F.lit("99 21 "), _padded(k % 1000000, 6))),
    )
    front = F.array(
        word(0, 0, "РЕГИСТРАЦИОННЫЙ ЗНАК"), word(0, 400, F.concat(F.lit("А"), _padded(k % 1000, 3), F.lit("ВС64"))), word(1, 0, "Год выпуска ТС"), word(1, 400, (k % 30 + 1990).cast("string")),
        word(2, 0, "Мощность двигателя кВт/л.с."), word(2, 400, "78"), word(2, 440, "106"), word(3, 0, "Идентификационный номер VIN"), word(3, 400, F.concat(F.lit("XTA2112900"), _padded(k, 7))),
    )
    tokens = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.inline(F.when(k % 2 == 0, back).otherwise(front)))
    one = {"page_width": 1000, "block": 1, "par": 1, "height": 20}
    return tokens.withColumns({n: F.lit(v) for n, v in one.items()} | {"width": F.length("text") * 12})


@query("""
    WITH d AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN ';color=БЕЛЫЙ' ELSE '' END AS more, CAST(1990 + c_custkey % 30 AS VARCHAR) AS y FROM customer)
    SELECT doc_id, 'sts_back' AS doc_type, 'city=Г. САРАТОВ' || more || ';doc_number=99 21 ' || lpad(CAST(doc_id % 1000000 AS VARCHAR), 6, '0') || ';issue_date=01.02.' || y || ';owner_last='
           || CASE doc_id % 3 WHEN 0 THEN 'ИВАНОВ' WHEN 1 THEN 'ПЕТРОВА' ELSE 'СИДОРОВ' END AS fields FROM d WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 'sts_front', substr(more || ';plate=А' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || 'ВС64;power_hp=106;power_kw=78;vin=XTA2112900' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || ';year=' || y, 2)
    FROM d WHERE doc_id % 2 = 1""")
def layout_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and fields of printed documents: lines, votes, labels, values, numbers found by their form, and a second pass that fills gaps."""
    lines = layout.split_lines(_pages(spark, sf_dir))
    types = layout.doc_types(lines)
    found = layout.fields_of_values(layout.labelled_values(lines, types))
    texts = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    whole = found.join(texts, "doc_id").withColumn("fields", layout.regex_fallbacks(F.col("fields"), F.col("doc_type"), F.col("text")))
    second = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("color"), F.lit("БЕЛЫЙ"))).otherwise(F.create_map().cast("map<string,string>"))
    fields = layout.best_pass(F.col("fields"), second, F.lit(10))
    entries = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return whole.select("doc_id", "doc_type", F.array_join(entries, ";").alias("fields"))


def _passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with places of a vehicle passport from each customer: full names with and without a comma and a middle name, addresses in one line and in two."""
    k = F.col("c_custkey")
    word = lambda line, left, text: F.struct(F.lit(line).alias("line"), F.lit(left).alias("left"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))
    page = F.array(
        word(0, 0, "ПАСПОРТ ТРАНСПОРТНОГО СРЕДСТВА"), word(1, 520, F.concat(F.lit("63 ОХ "), _padded(k % 1000000, 6))), word(2, 0, "10. Мощность двигателя, л.с. (кВт)"), word(2, 520, "106"), word(2, 570, "(78)"),
        word(3, 0, "21. Наименование (ФИО) собственника ТС"), word(3, 520, F.when(k % 4 == 0, "СИДОРОВ СЕМЕН").otherwise("ИВАНОВА, АННА ПЕТРОВНА")),
        word(4, 0, "22. Адрес"), word(4, 520, F.when(k % 3 == 0, "САРАТОВСКАЯ ОБЛ").otherwise("САРАТОВСКАЯ ОБЛ, Г. САРАТОВ")), word(5, 520, F.when(k % 3 != 0, F.concat(F.lit("УЛ. ЛЕНИНА, "), (k % 50 + 1).cast("string")))),
        word(6, 0, "24. Дата выдачи паспорта"), word(6, 520, F.concat(F.lit("01.02."), (k % 30 + 1990).cast("string"))),
    )
    tokens = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.inline(page)).where("text is not null")
    one = {"page_width": 1000, "block": 1, "par": 1, "height": 20}
    return tokens.withColumns({n: F.lit(v) for n, v in one.items()} | {"width": F.length("text") * 12})


@query("""
    SELECT c_custkey AS doc_id, 'pts' AS doc_type,
           'city=' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Г. САРАТОВ' END || ';doc_number=63 ОХ ' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') || ';issue_date=01.02.' || CAST(1990 + c_custkey % 30 AS VARCHAR)
           || CASE WHEN c_custkey % 4 = 0 THEN ';owner_first=СЕМЕН;owner_last=СИДОРОВ' ELSE ';owner_first=АННА;owner_last=ИВАНОВА;owner_middle=ПЕТРОВНА' END || ';power_hp=106;power_kw=78;region=САРАТОВСКАЯ ОБЛ'
           || CASE WHEN c_custkey % 3 <> 0 THEN ';street_address=УЛ. ЛЕНИНА, ' || CAST(c_custkey % 50 + 1 AS VARCHAR) ELSE '' END AS fields
    FROM customer""")
def layout_passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and fields of printed passports: a pair of powers in their label's order, a full name, and an address that goes on in an unlabelled line."""
    read = layout.read_documents(_passports(spark, sf_dir))
    entries = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return read.select("doc_id", "doc_type", F.array_join(entries, ";").alias("fields"))
