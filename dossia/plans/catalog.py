"""Named queries over the shared tables and the SQL that must give the same rows.

The tables hold no vehicle documents, so document-like rows are derived from keys, in the same way here and in the SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.functions import canon as C
from dossia.functions.answers import extraction
from dossia.functions.regions import plate_codes
from dossia.operators import layout, linking, metrics, quality
from dossia.operators.checkpoints import shared_dir
from dossia.plans.predicates import Cond, any_text, compile_all, kinds_of, search, vocabulary
from dossia.schema import EPTS, PTS, STS_BACK, STS_FRONT
from dossia.sources import fill
from dossia.sources.generate import split_by
from dossia.sources.labels import annotations, as_json, in_one_line, long_fields, read_records, write_coco, write_jsonl
from dossia.streaming.runs import late_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- search -------------------------------------------------------------------------------------------------------


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that meet conditions, with their numbers of orders."""
    return nlq_filter_topn(spark, sf_dir)


@query("""
    SELECT c.c_custkey, c.c_name, c.c_acctbal, n.n_name, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS doc_count,
           (SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders o WHERE o.o_custkey = c.c_custkey) AS doc_types
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE (n.n_name = 'NATION_3' OR n.n_name = 'NATION_7') AND c.c_acctbal > 1000 AND c.c_custkey BETWEEN 10 AND 100000
    ORDER BY c.c_custkey LIMIT 25""")
def nlq_filter_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cards = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    conds = [Cond("n_name", "=", "NATION_3"), Cond("n_name", "=", "NATION_7"), Cond("c_acctbal", ">", 1000), Cond("c_custkey", "between", (10, 100000)), Cond("no_such", "=", 1)]
    found = search(cards, conds, order="c_custkey", limit=25)  # the feature is the first 25
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return linking.doc_counts(found, orders, "c_custkey", "o_custkey", "o_orderstatus").select("c_custkey", "c_name", "c_acctbal", "n_name", "doc_count", "doc_types")


@query("""
    SELECT p_partkey, p_name, p_brand FROM part
    WHERE (p_brand = 'Brand#2' OR p_brand = 'Brand#17') AND (upper(p_name) LIKE '%RING%' OR upper(p_name) LIKE '%WIDGET%' OR upper(p_name) LIKE '%BOLT%')""")
def nlq_like_or_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    conds = [Cond("p_brand", "=", "Brand#2"), Cond("p_brand", "=", "Brand#17"), *[Cond("p_name", "like", w) for w in ("ring", "widget", "bolt")]]
    return part.where(compile_all(conds, kinds_of(part))).select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, p_name FROM part WHERE length(p_name) = 9 AND (length(p_brand) = 7 OR length(p_type) = 7)")
def nlq_len_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.where(compile_all([Cond("p_name", "len", 9), Cond("p_brand|p_type", "len", 7)], kinds_of(part))).select("p_partkey", "p_name")


@query("""
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderkey BETWEEN 5 AND 50000 AND (o_orderstatus = 'F' OR o_orderstatus = 'O') AND contains(upper(o_orderpriority), 'I')""")
def nlq_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of different columns or operations must all hold, also two on one column; equalities of one column are alternatives."""
    orders = table(spark, sf_dir, "orders")
    conds = [
        Cond("o_totalprice", ">=", 1000), Cond("o_orderstatus", "=", "F"), Cond("o_totalprice", "<", 200000), Cond("o_orderkey", "between", (5, 50000)), Cond("o_orderstatus", "=", "O"), Cond("o_orderpriority", "like", "i"),
    ]
    return orders.where(compile_all(conds, kinds_of(orders))).select("o_orderkey", "o_totalprice")


@query("""
    SELECT doc_id FROM documents
    WHERE (contains(upper(text), 'IDIOT') OR contains(upper(source), 'IDIOT')) AND (contains(upper(text), 'SRC1') OR contains(upper(source), 'SRC1'))""")
def nlq_fulltext_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(any_text(["idiot", "src1"], ["text", "source"])).select("doc_id")


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL")
def vocab_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(table(spark, sf_dir, "part"), "p_brand")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return search(cards, [Cond("c_custkey", "=", 42)], order="c_custkey", limit=1)  # the feature is one card


@query("SELECT (SELECT count(*) FROM customer) AS cards, (SELECT count(*) FROM orders) AS documents")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.table_counts({"cards": table(spark, sf_dir, "customer"), "documents": table(spark, sf_dir, "orders")})


@query("""
    SELECT c.c_custkey, count(o.o_orderkey) AS doc_count, string_agg(DISTINCT o.o_orderstatus, ',' ORDER BY o.o_orderstatus) AS doc_types
    FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey""")
def card_doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return linking.doc_counts(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey", "o_orderstatus")


# ---- canonical forms ----------------------------------------------------------------------------------------------

_BASE = "trim(regexp_replace(translate(upper({0}), 'Ё', 'Е'), '\\s+', ' ', 'g'), ' .,;:')"
_LAT = "translate({0}, 'АВЕКМНОРСТУХ', 'ABEKMHOPCTYX')"
_CYR = "translate({0}, 'ABEKMHOPCTYX', 'АВЕКМНОРСТУХ')"


@query("""
    SELECT c_custkey, translate(regexp_replace(translate(upper('хта-' || lpad(CAST(c_custkey AS VARCHAR), 12, 'O') || ' qi'), 'АВЕКМНОРСТУХ', 'ABEKMHOPCTYX'), '[\\s-]', '', 'g'), 'OIQ', '010') AS vin,
           regexp_replace(CAST(c_custkey AS VARCHAR) || '-' || CAST(c_nationkey AS VARCHAR), '[\\s-]', '', 'g') AS code
    FROM customer""")
def canon_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    vin = F.concat(F.lit("хта-"), F.lpad(F.col("c_custkey").cast("string"), 12, "O"), F.lit(" qi"))
    code = F.concat_ws("-", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.canon("vin", vin).alias("vin"), C.canon("gibdd_code", code).alias("code"))


@query("""
    SELECT c_custkey, regexp_replace(regexp_replace('00' || CAST(c_custkey * 7 AS VARCHAR) || ' л.с. (' || CAST(c_nationkey AS VARCHAR) || ')', '[^0-9]', '', 'g'), '^0+(.)', '\\1') AS hp,
           CAST(round_even(c_custkey * 0.7355, 0) AS INTEGER) AS kw
    FROM customer""")
def canon_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("00"), (F.col("c_custkey") * 7).cast("string"), F.lit(" л.с. ("), F.col("c_nationkey").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.canon("power_hp", raw).alias("hp"), C.hp_to_kw(F.col("c_custkey")).alias("kw"))


@query("""
    SELECT o_orderkey, lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') || '.' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '.' || CAST(year(o_orderdate) AS VARCHAR) AS issued,
           CAST(o_orderdate AS DATE) AS issued_on
    FROM orders""")
def canon_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("от "), F.dayofmonth("o_orderdate"), F.lit(" / "), F.month("o_orderdate"), F.lit("-"), F.year("o_orderdate"), F.lit(" г."))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.canon("issue_date", raw).alias("issued"), C.date_value(raw).alias("issued_on"))


@query("""
    SELECT p_partkey, regexp_replace(upper(p_name || ' (' || p_brand || ')'), '[^А-ЯA-Z0-9]', '', 'g') AS manufacturer,
           regexp_replace(translate(upper(p_name), 'ABEKMHOPCTYX', 'АВЕКМНОРСТУХ'), '[^А-ЯA-Z0-9]', '', 'g') AS color
    FROM part""")
def canon_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", C.canon("manufacturer", made).alias("manufacturer"), C.canon("color", F.col("p_name")).alias("color"))


@query("""
    WITH r AS (SELECT c_custkey, 'А' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '8С' || CAST(c_nationkey + 10 AS VARCHAR) AS s FROM customer)
    SELECT c_custkey, translate(substr(s, 1, 1), '08', 'ОВ') || substr(s, 2, 3) || translate(substr(s, 5, 2), '08', 'ОВ') || substr(s, 7) AS plate FROM r""")
def fix_plate_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.translate(F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), "036", "ОЗБ")
    raw = F.concat(F.lit("a"), number, F.lit("8c | "), (F.col("c_nationkey") + 10).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.canon("plate", raw).alias("plate"))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '63ОХ' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE '6301' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS series FROM customer""")
def fix_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = F.when(F.col("c_custkey") % 2 == 0, "0X").otherwise("01")
    raw = F.concat(F.lit("63 "), middle, F.lit(" № "), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.canon("doc_number", raw).alias("series"))


@query("""
    WITH v AS (SELECT c_custkey, 'XTA211290B' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS vin FROM customer),
    p AS (SELECT c_custkey, CAST(translate(substr(vin, CAST(i AS INTEGER), 1), 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789') AS INTEGER) * w AS x
          FROM v, (VALUES (1,8),(2,7),(3,6),(4,5),(5,4),(6,3),(7,2),(8,10),(9,0),(10,9),(11,8),(12,7),(13,6),(14,5),(15,4),(16,3),(17,2)) AS t(i, w))
    SELECT c_custkey, CASE WHEN sum(x) % 11 = 10 THEN 'X' ELSE CAST(CAST(sum(x) % 11 AS INTEGER) AS VARCHAR) END AS digit FROM p GROUP BY c_custkey""")
def vin_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    vin = F.concat(F.lit("XTA211290B"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.vin_check_digit(vin).alias("digit"))


@query("""
    SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '64' WHEN 1 THEN '777' WHEN 2 THEN '16' WHEN 3 THEN '152' ELSE '00' END AS code,
           CASE s_suppkey % 5 WHEN 0 THEN 'САРАТОВСКАЯ ОБЛ' WHEN 1 THEN 'Г. МОСКВА' WHEN 2 THEN 'РЕСП. ТАТАРСТАН' WHEN 3 THEN 'НИЖЕГОРОДСКАЯ ОБЛ' END AS region,
           n.n_name, r.r_name
    FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, ("64", "777", "16", "152", "00"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", code.alias("code"))
    joined = suppliers.join(F.broadcast(plate_codes(spark)), "code", "left").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", "code", "region", "n_name", "r_name")


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 3 END AS n_keys, 'СЕРЫЙ' AS color,
           CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'УЛ. ЕЛОВАЯ, Д. ' || CAST(c_custkey AS VARCHAR) END AS street, 'KIA RIO' AS make
    FROM customer""")
def clean_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    street = F.when(F.col("c_custkey") % 3 == 0, "нет данных").otherwise(F.concat(F.lit(" ул. ёловая,  д. "), F.col("c_custkey").cast("string"), F.lit(".")))
    entries = {"color": F.lit("cеpый;"), "street_address": street, "make_model": F.lit("КIА  rio"), "city": F.lit(None).cast("string")}
    fields = C.clean_fields(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]))
    df = table(spark, sf_dir, "customer").select("c_custkey", fields.alias("f"))
    at = lambda k: F.element_at("f", F.lit(k))
    return df.select("c_custkey", F.size("f").alias("n_keys"), at("color").alias("color"), at("street_address").alias("street"), at("make_model").alias("make"))


@query("""
    SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'epts' WHEN 1 THEN 'sts_front' WHEN 2 THEN 'sts_back' WHEN 3 THEN 'pts' WHEN 4 THEN 'pts' END AS doc_type FROM customer""")
def detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [("epts_status", "vin"), ("plate", "vin"), ("owner_last", "city"), ("vin", "year"), ("gibdd_code", "vin"), ("year", "color")]
    fields = F.element_at(F.array(*[F.create_map(*[x for k in ks for x in (F.lit(k), F.lit("X1"))]) for ks in kinds]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", quality.detect_doc_type(fields).alias("doc_type"))


@query("""
    SELECT c_custkey, c_custkey % 137 AS n, CASE WHEN c_custkey % 137 % 10 = 1 AND c_custkey % 137 % 100 <> 11 THEN 'документ'
        WHEN c_custkey % 137 % 10 BETWEEN 2 AND 4 AND c_custkey % 137 % 100 NOT BETWEEN 12 AND 14 THEN 'документа' ELSE 'документов' END AS word,
        regexp_replace(c_name || ' / 1', '[^A-Za-z0-9._-]+', '_', 'g') AS safe
    FROM customer""")
def report_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") % 137
    return table(spark, sf_dir, "customer").select("c_custkey", n.alias("n"), C.docs_word(n).alias("word"), C.safe_name(F.concat("c_name", F.lit(" / 1"))).alias("safe"))


# ---- quality ------------------------------------------------------------------------------------------------------

_CHECKS = """
    WITH d AS (SELECT o_orderkey, CAST(1940 + o_orderkey % 100 AS BIGINT) AS made, CAST(o_custkey % 200 AS BIGINT) AS hp, CAST(o_orderkey % 150 AS BIGINT) AS kw,
                      CAST(o_custkey AS BIGINT) AS curb, CAST(o_orderkey % 1500 AS BIGINT) AS top, year(o_orderdate) AS issued FROM orders),
    c AS (
        SELECT o_orderkey, CASE WHEN abs(round_even(hp * 0.7355, 0) - kw) > 1 THEN 'warn' ELSE 'ok' END AS level, 'power_kw' AS field FROM d WHERE hp <> 0 AND kw <> 0
        UNION ALL SELECT o_orderkey, CASE WHEN curb < top THEN 'ok' ELSE 'warn' END, 'curb_mass' FROM d WHERE curb <> 0 AND top <> 0
        UNION ALL SELECT o_orderkey, 'error', 'year' FROM d WHERE made NOT BETWEEN 1950 AND 2026
        UNION ALL SELECT o_orderkey, 'warn', 'issue_date' FROM d WHERE issued < made - 1
        UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'error' ELSE 'ok' END, 'doc_number' FROM d)
"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    number = F.when(F.col("o_orderkey") % 7 == 0, F.lit("12 34")).otherwise(F.concat(F.lit("99 21 "), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0")))
    values = {
        "year": (F.col("o_orderkey") % 100 + 1940).cast("string"), "power_hp": (F.col("o_custkey") % 200).cast("string"), "power_kw": (F.col("o_orderkey") % 150).cast("string"),
        "curb_mass": F.col("o_custkey").cast("string"), "max_mass": (F.col("o_orderkey") % 1500).cast("string"), "issue_date": day, "doc_number": number,
    }
    fields = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return quality.with_checks(table(spark, sf_dir, "orders").select("o_orderkey", F.lit(STS_FRONT).alias("doc_type"), fields.alias("fields")), 2025)


@query(_CHECKS + "SELECT o_orderkey, level, field FROM c")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.findings(_checked(spark, sf_dir), "o_orderkey").select("o_orderkey", "level", "field")


@query("""
    WITH d AS (SELECT o_orderkey, CAST(1940 + o_orderkey % 100 AS BIGINT) AS made, CAST(o_custkey % 200 AS BIGINT) AS hp, CAST(o_orderkey % 150 AS BIGINT) AS kw, CAST(o_custkey AS BIGINT) AS curb, CAST(o_orderkey % 1500 AS BIGINT) AS top,
                      year(o_orderdate) AS issued, CAST(round_even(CAST(o_custkey % 200 AS BIGINT) * 0.7355, 0) AS BIGINT) AS want FROM orders)
    SELECT o_orderkey, 'power_kw' AS field, CASE WHEN abs(want - kw) > 1 THEN CAST(hp AS VARCHAR) || ' л.с. дают ' || CAST(want AS VARCHAR) || ' кВт, а указано ' || CAST(kw AS VARCHAR) ELSE 'Обе мощности согласуются' END AS message FROM d WHERE hp <> 0 AND kw <> 0
    UNION ALL SELECT o_orderkey, 'curb_mass', CASE WHEN curb < top THEN 'Обе массы согласуются' ELSE 'Пустая машина тяжелее, чем разрешено гружёной' END FROM d WHERE curb <> 0 AND top <> 0
    UNION ALL SELECT o_orderkey, 'year', 'Таким год выпуска быть не может: ' || CAST(made AS VARCHAR) FROM d WHERE made NOT BETWEEN 1950 AND 2026
    UNION ALL SELECT o_orderkey, 'issue_date', 'Дата выдачи раньше года выпуска' FROM d WHERE issued < made - 1""")
def quality_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages on powers, masses, years and dates."""
    return quality.findings(_checked(spark, sf_dir), "o_orderkey").select("o_orderkey", "field", "message").where("field <> 'doc_number'")


@query(_CHECKS + "SELECT level, field, count(*) AS n FROM c GROUP BY level, field")
def quality_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_counts(_checked(spark, sf_dir))


# ---- scores -------------------------------------------------------------------------------------------------------

_SCORED = """
    WITH v(variant, s) AS (VALUES ('clean', 0), ('photo', 1), ('blur:2', 2), ('blur:4', 5)),
    t AS (SELECT c_custkey, 'manufacturer' AS key, 0 AS j, c_name AS val FROM customer
          UNION ALL SELECT c_custkey, 'year', 1, CAST(1990 + c_custkey % 30 AS VARCHAR) FROM customer
          UNION ALL SELECT c_custkey, 'make_model', 2, c_mktsegment FROM customer),
    r AS (SELECT v.variant, v.s, t.c_custkey, t.key, t.val,
                 CASE WHEN (t.c_custkey + t.j) % 11 < v.s - 1 THEN '' WHEN (t.c_custkey * 7 + t.j * 3) % 10 < v.s THEN 'X' || substr(t.val, 2) ELSE t.val END AS pred
          FROM t, v WHERE NOT (v.variant <> 'clean' AND t.c_custkey % 17 = 0)),
    k AS (SELECT *, CASE key WHEN 'year' THEN regexp_replace(regexp_replace(val, '[^0-9]', '', 'g'), '^0+(.)', '\\1') WHEN 'make_model' THEN regexp_replace(translate(upper(val), 'АВЕКМНОРСТУХ', 'ABEKMHOPCTYX'), '[^А-ЯA-Z0-9]', '', 'g')
                         ELSE regexp_replace(upper(val), '[^А-ЯA-Z0-9]', '', 'g') END AS ct,
                    CASE key WHEN 'year' THEN regexp_replace(regexp_replace(pred, '[^0-9]', '', 'g'), '^0+(.)', '\\1') WHEN 'make_model' THEN regexp_replace(translate(upper(pred), 'АВЕКМНОРСТУХ', 'ABEKMHOPCTYX'), '[^А-ЯA-Z0-9]', '', 'g')
                         ELSE regexp_replace(upper(pred), '[^А-ЯA-Z0-9]', '', 'g') END AS cp FROM r),
    f AS (SELECT variant, s, c_custkey, key, ct = cp AS ok, least(1.0, CAST(levenshtein(cp, ct) AS DOUBLE) / length(ct)) AS cer,
                 CASE WHEN c_custkey % 2 = 0 THEN 'pts' ELSE 'epts' END AS doc_type,
                 CASE WHEN c_custkey % 9 < s THEN NULL WHEN c_custkey % 2 = 0 THEN 'pts' ELSE 'epts' END AS pred_type, 1 + (c_custkey % 13) * s / 4.0 AS seconds, c_custkey % 50 < s AS failed FROM k),
    p AS (SELECT variant, c_custkey, count(*) AS n, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS good, min(CASE WHEN ok THEN 1 ELSE 0 END) AS all_ok, sum(cer) AS cer,
                 max(CASE WHEN pred_type = doc_type THEN 1 ELSE 0 END) AS type_ok, max(seconds) AS seconds, max(CASE WHEN failed THEN 1 ELSE 0 END) AS failed FROM f GROUP BY variant, c_custkey)
"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored fields of documents derived from customers: four variants, worse from one to the next."""
    key = F.col("c_custkey")
    values = [("manufacturer", F.col("c_name")), ("year", (key % 30 + 1990).cast("string")), ("make_model", F.col("c_mktsegment"))]
    customers = table(spark, sf_dir, "customer")
    kind = F.when(key % 2 == 0, PTS).otherwise(EPTS)
    true = F.create_map(*[x for k, v in values for x in (F.lit(k), v)])
    truth = customers.select(key.cast("string").alias("id"), kind.alias("doc_type"), true.alias("fields"))
    variants = F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(s).alias("s")) for v, s in (("clean", 0), ("photo", 1), ("blur:2", 2), ("blur:4", 5))]))
    r = customers.select("*", variants).where(~((F.col("variant") != "clean") & (key % 17 == 0)))
    spoiled = lambda j, v: F.when((key + j) % 11 < F.col("s") - 1, F.lit(None)).when((key * 7 + j * 3) % 10 < F.col("s"), F.concat(F.lit("X"), F.substring(v, 2, 1000))).otherwise(v)
    pred = F.create_map(*[x for j, (k, v) in enumerate(values) for x in (F.lit(k), spoiled(j, v))])
    records = r.select(
        key.cast("string").alias("id"), "variant", F.when(~(key % 9 < F.col("s")), kind).alias("pred_doc_type"), (1 + (key % 13) * F.col("s") / 4.0).alias("seconds"),
        F.when(key % 50 < F.col("s"), "failed").alias("error"), pred.alias("fields"),
    )
    return metrics.scored_fields(records, truth)


@query(_SCORED + """
    SELECT variant, count(*) AS documents, CAST(sum(n) AS BIGINT) AS fields, round(sum(good) / sum(n), 6) AS field_accuracy, round(avg(all_ok), 6) AS document_accuracy,
           round(avg(type_ok), 6) AS doc_type_accuracy, round(sum(cer) / sum(n), 6) AS mean_cer, median(seconds) AS median_seconds, CAST(sum(failed) AS BIGINT) AS errors FROM p GROUP BY variant""")
def score_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.score(_fields(spark, sf_dir))
    return scores.withColumns({c: F.round(c, 6) for c in ("field_accuracy", "document_accuracy", "doc_type_accuracy", "mean_cer")})


@query(_SCORED + """
    SELECT variant, NULL AS key, NULL AS doc_type, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM f GROUP BY variant
    UNION ALL SELECT variant, key, NULL, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6), count(*) FROM f GROUP BY variant, key
    UNION ALL SELECT variant, NULL, doc_type, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6), count(*) FROM f GROUP BY variant, doc_type""")
def score_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy_cube(_fields(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(_SCORED + """
    , b AS (SELECT 'blur' AS kind, CAST(split_part(variant, ':', 2) AS INTEGER) AS level, c_custkey, ok FROM f WHERE contains(variant, ':')),
    a AS (SELECT kind, level, ok FROM b UNION ALL
          SELECT 'blur', 0, ok FROM f WHERE variant = 'clean' AND c_custkey IN (SELECT c_custkey FROM b))
    SELECT kind, level, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS accuracy FROM a GROUP BY kind, level""")
def robustness_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.robustness(_fields(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query("""
    SELECT c_custkey, 'c_name' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer
    UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer""")
def fields_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(*[x for c in ("c_name", "c_mktsegment", "c_nationkey") for x in (F.lit(c), F.col(c).cast("string"))])
    return long_fields(table(spark, sf_dir, "customer").select("c_custkey", fields.alias("fields")), "c_custkey")


@query("""
    SELECT CAST(d.doc_id AS VARCHAR) AS id, v.variant FROM documents d, (VALUES ('clean'), ('photo')) AS v(variant)
    WHERE NOT (v.variant = 'clean' AND d.doc_id IN (SELECT doc_id FROM labels))""")
def resume_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit("clean").alias("variant"))
    return metrics.worklist(items, spark.createDataFrame([("clean",), ("photo",)], "variant string"), done)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def first_n_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.first_per_group(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 3)


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def stress_common_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ids_of_all(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def last_record_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest(table(spark, sf_dir, "events"), "event_id", ("user_id", "event_type")).select("user_id", "event_id", "value")


@query("SELECT CASE WHEN (c_custkey * 7919) % 100 < 30 THEN 'test' ELSE 'dev' END AS split, count(*) AS n, count(DISTINCT c_nationkey) AS groups FROM customer GROUP BY 1")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_by(F.col("c_custkey") * 7919 % 100, 30)
    return table(spark, sf_dir, "customer").groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("groups"))


@query("""
    WITH h AS (SELECT substr(sha256(CAST(item_id AS VARCHAR)), 1, 3) AS b, CAST(item_id AS VARCHAR) AS k, sha256(CAST(item_id AS VARCHAR) || chr(1) || text) AS h FROM benchmark),
    p AS (SELECT b, sha256(string_agg(h, '' ORDER BY k)) AS h FROM h GROUP BY b)
    SELECT substr(sha256(string_agg(h, '' ORDER BY b)), 1, 12) AS fingerprint FROM p""")
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fingerprint(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))


# ---- linking ------------------------------------------------------------------------------------------------------

_LINKED = "(SELECT c_custkey AS seq, CAST(c_custkey // 3 AS VARCHAR) AS vin, CASE WHEN c_custkey % 4 = 0 THEN CAST((c_custkey + 1) // 5 AS VARCHAR) END AS sts FROM customer)"


def _linkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("seq"), F.floor(key / 3).cast("string").alias("vin"), F.when(key % 4 == 0, F.floor((key + 1) / 5).cast("string")).alias("sts_number"), F.lit(None).cast("string").alias("pts_number")
    )


@query(f"""
    WITH RECURSIVE d AS {_LINKED},
    e AS (SELECT a.seq AS x, b.seq AS y FROM d a JOIN d b ON a.vin = b.vin UNION SELECT a.seq, b.seq FROM d a JOIN d b ON a.sts = b.sts),
    reach(x, y) AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
    SELECT x AS seq, min(y) AS component FROM reach GROUP BY x""")
def link_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link_documents(_linkable(spark, sf_dir)).select("seq", "component")


@query("""
    SELECT c_nationkey AS component, max_by(c_name, c_custkey) FILTER (WHERE c_custkey % 3 <> 0) AS c_name, max_by(c_mktsegment, c_custkey) FILTER (WHERE c_custkey % 5 <> 0) AS c_mktsegment, count(*) AS doc_count
    FROM customer GROUP BY c_nationkey""")
def golden_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    docs = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("component"), key.alias("seq"), F.when(key % 3 != 0, F.col("c_name")).alias("c_name"), F.when(key % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment")
    )
    return linking.golden_record(docs, ["c_name", "c_mktsegment"])


@query()
def fold_cards_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of documents derived from customers; three documents of a car, some sharing a certificate with another one."""
    key = F.col("c_custkey")
    number = F.when(key % 4 == 0, F.concat(F.lit("99"), F.lpad(F.floor((key + 1) / 5).cast("string"), 8, "0"))).otherwise("")
    fields = F.create_map(
        F.lit("vin"), F.concat(F.lit("XTA211290B"), F.lpad(F.floor(key / 3).cast("string"), 7, "0")), F.lit("doc_number"), number, F.lit("color"), F.col("c_mktsegment"), F.lit("year"), (key % 20 + 2000).cast("string")
    )
    kind = F.when(key % 2 == 0, STS_FRONT).otherwise(STS_BACK)
    docs = table(spark, sf_dir, "customer").select(key.alias("seq"), *linking.card_values(kind, fields))
    return linking.folded_cards(linking.link_documents(docs))


# ---- documents as text --------------------------------------------------------------------------------------------


@query("""
    SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_custkey % 4 = 1 THEN 'sts_front' ELSE 'pts' END AS doc_type,
           CASE WHEN c_custkey % 4 <> 3 THEN 'XTA211290B' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS vin, c_custkey % 4 = 3 AS failed,
           CASE c_custkey % 4 WHEN 3 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS n_fields
    FROM customer""")
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    vin = F.concat(F.lit("XTA211290B"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    text = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('<think>{"a": 1}</think>```json\n{"doc_type": "pts", "fields": {"vin": "'), vin, F.lit('", "unknown": "x", "year": null}}\n```')))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit('So: {"plate": "а123вс164", "vin": "'), vin, F.lit('"} done')))
        .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit('{"doc_type": "other", "fields": {"vin": "'), vin, F.lit('"}}')))
        .otherwise("I can't {read this}")
    )
    done = extraction(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("answer")))
    return done.select("id", "doc_type", F.element_at("fields", "vin").alias("vin"), F.col("error").isNotNull().alias("failed"), F.size("fields").alias("n_fields"))


@query("""
    SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = (F.col("l_partkey") % 1000).cast("int")
    one = lambda n: F.lit(n)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), one(2000).alias("page_width"), one(1).alias("block"), one(1).alias("par"), one(1).alias("line"),
        F.concat(F.lit("Z"), F.col("l_linenumber").cast("string")).alias("text"), left.alias("left"), one(0).alias("top"), one(20).alias("width"), one(10).alias("height"),
    )


@query("""
    WITH t AS (SELECT l_orderkey AS doc_id, 'Z' || CAST(l_linenumber AS VARCHAR) AS text, l_partkey % 1000 AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 1000, 'Z' || CAST(l_linenumber AS VARCHAR)) AS n FROM lineitem),
    g AS (SELECT *, lead(x) OVER (PARTITION BY doc_id ORDER BY n) - (x + 20) AS gap, min(x) OVER (PARTITION BY doc_id) AS leftmost FROM t),
    c AS (SELECT doc_id, CASE WHEN min(leftmost) > 600 THEN 0 ELSE coalesce(min(CASE WHEN gap > 28 THEN n END), count(*)) END AS at, count(*) AS n FROM g GROUP BY doc_id)
    SELECT c.doc_id, c.n - c.at AS n_value, coalesce(string_agg(CASE WHEN t.n <= c.at THEN lower(t.text) END, ' ' ORDER BY t.n), '') AS label FROM c JOIN t ON c.doc_id = t.doc_id GROUP BY c.doc_id, c.n, c.at""")
def line_gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.split_lines(_tokens(spark, sf_dir))
    return lines.select("doc_id", F.size("tokens").cast("long").alias("n_value"), "label")


LABEL_WORDS = ["small ring", "red widget", "blue bolt", "hot gear", "green gizmo"]


@query("""
    WITH p AS (SELECT DISTINCT p_name FROM part), l(label) AS (VALUES ('small ring'), ('red widget'), ('blue bolt'), ('hot gear'), ('green gizmo')),
    d AS (SELECT p_name, label, levenshtein(p_name, label) AS distance FROM p, l)
    SELECT p_name, label, distance FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY distance, label DESC) AS n FROM d) WHERE n = 1""")
def fuzzy_label_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    near = layout.nearest_by_edits(F.col("p_name"), LABEL_WORDS)
    return names.select("p_name", near["label"].alias("label"), near["distance"].cast("long").alias("distance"))


@query(f"""
    WITH RECURSIVE p AS (SELECT a, b FROM (SELECT DISTINCT p_name AS a FROM part), (SELECT unnest({LABEL_WORDS!r}) AS b)),
    f(a, b, i, best) AS (
        SELECT a, b, 0, [0 FOR j IN range(0, length(b) + 1)] FROM p
        UNION ALL
        SELECT a, b, i + 1, [list_max(now[1:j]) FOR j IN range(1, length(b) + 2)]
        FROM (SELECT a, b, i, [CASE WHEN j > 1 AND substr(a, i + 1, 1) = substr(b, j - 1, 1) THEN greatest(best[j], best[j - 1] + 1) ELSE best[j] END FOR j IN range(1, length(b) + 2)] AS now FROM f WHERE i < length(a)))
    SELECT a AS p_name, b AS label, CAST(200 * best[length(b) + 1] AS DOUBLE) / (length(a) + length(b)) AS ratio FROM f WHERE i = length(a)""")
def lcs_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of distinct part names to a few labels by longest common subsequence."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    pairs = names.select("p_name", F.explode(F.array(*map(F.lit, LABEL_WORDS))).alias("label"))
    return pairs.select("p_name", "label", layout.lcs_ratio_udf("p_name", "label").alias("ratio"))


@query("""
    WITH i AS (SELECT CAST(p_partkey AS VARCHAR) AS item, p_size AS x, CAST(p_partkey % 100 AS INTEGER) AS y FROM part),
    b AS (SELECT item, 0 AS pos, 'color' AS key, x, y, x + 10 AS x2, y + 5 AS y2 FROM i UNION ALL SELECT item, 1, 'vin', x, y, x + y, y + 7 FROM i)
    SELECT row_number() OVER (ORDER BY item || '/' || lpad(CAST(pos AS VARCHAR), 6, '0')) AS id, item, CASE key WHEN 'color' THEN 5 ELSE 28 END AS category_id, x || ',' || y || ',' || (x2 - x) || ',' || (y2 - y) AS bbox,
           (x2 - x) * (y2 - y) AS area, CASE key WHEN 'color' THEN 'red' ELSE '' END AS value FROM b""")
def coco_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_size"), (F.col("p_partkey") % 100).cast("int")
    boxes = F.create_map(F.lit("vin"), F.array(x, y, x + y, y + 7), F.lit("color"), F.array(x, y, x + 10, y + 5))
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), boxes.alias("boxes"), F.create_map(F.lit("color"), F.lit("red")).alias("fields"))
    boxes = F.array_join(F.col("bbox").cast("array<string>"), ",").alias("bbox")
    return annotations(items, spark).select("id", "item", "category_id", boxes, "area", "value")


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS id, 'clean' AS variant, CASE WHEN c_custkey % 3 = 0 THEN 3 WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS round,
           CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Ю ' || c_name END AS owner, CASE WHEN c_custkey % 3 = 0 THEN 'no answer' END AS error FROM customer""")
def record_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of extraction records of all customers, written, appended to twice and read back in the order of the appends; the last record of each counts."""
    k = F.col("c_custkey")
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    for n, (again, failed) in enumerate([(F.lit(True), False), (k % 2 == 0, False), (k % 3 == 0, True)], 1):
        owner = F.lit(None).cast("string") if failed else F.concat(F.lit("Ю "), "c_name")
        fields = F.when(owner.isNotNull(), F.create_map(F.lit("owner_last"), owner))
        rows = table(spark, sf_dir, "customer").where(again).select(
            k.cast("string").alias("id"), F.lit("clean").alias("variant"), fields.alias("fields"), F.lit(float(n)).alias("seconds"), F.lit("no answer" if failed else None).cast("string").alias("error")
        )
        write_jsonl(rows, path, append=True)
    last = metrics.latest(read_records(spark, path), "seq")
    return last.select("id", "variant", F.col("seconds").cast("int").alias("round"), F.element_at("fields", "owner_last").alias("owner"), "error")


@query("""
    WITH i AS (SELECT CAST(p_partkey AS VARCHAR) AS item, p_partkey % 3 AS n, p_size AS x FROM part),
    m AS (SELECT item, row_number() OVER (ORDER BY item) AS image_id FROM i),
    b AS (SELECT item, 0 AS pos, 5 AS category_id, x FROM i WHERE n > 0 UNION ALL SELECT item, 1, 28, x FROM i WHERE n > 1)
    SELECT row_number() OVER (ORDER BY item, pos) AS id, image_id, category_id, x || ',0,10,5' AS bbox, 50 AS area, 0 AS iscrowd, CASE category_id WHEN 5 THEN 'red' ELSE '' END AS value, 'p' || item || '.jpg' AS file_name
    FROM b JOIN m USING (item)""")
def coco_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data set written for annotation tools, read back: annotations with their images; items may have no box."""
    k, x = F.col("p_partkey"), F.col("p_size")
    one = F.array(x, F.lit(0), x + 10, F.lit(5))
    boxes = F.map_filter(F.create_map(F.lit("vin"), one, F.lit("color"), one), lambda name, _: F.when(name == "color", k % 3 > 0).otherwise(k % 3 > 1))
    fields = F.create_map(F.lit("color"), F.lit("red"))
    items = table(spark, sf_dir, "part").select(
        k.cast("string").alias("id"), F.concat(F.lit("p"), k.cast("string"), F.lit(".jpg")).alias("image"), F.lit(1).alias("width"), F.lit(2).alias("height"), F.lit(PTS).alias("doc_type"), F.lit("test").alias("split"),
        boxes.alias("boxes"), fields.alias("fields"),
    )
    path = f"{shared_dir(spark)}/coco-{uuid.uuid4().hex}"
    write_coco(items, path)
    images = spark.read.schema("id long, file_name string").json(f"{path}/images").select(F.col("id").alias("image_id"), "file_name")
    kinds = "id long, image_id long, category_id int, bbox array<int>, area int, iscrowd int, attributes struct<value:string>"
    rows = spark.read.schema(kinds).json(f"{path}/annotations").join(images, "image_id")
    return rows.select("id", "image_id", "category_id", F.array_join(F.col("bbox").cast("array<string>"), ",").alias("bbox"), "area", "iscrowd", "attributes.value", "file_name")


@query("""
    SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY l_returnflag""")
def median_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of large groups, by counting ranges of values."""
    return metrics.exact_median(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


@query("""
    WITH h AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS b, CAST(doc_id AS VARCHAR) AS k, sha256(CAST(doc_id AS VARCHAR) || chr(1) || coalesce(text, chr(2))) AS h FROM documents),
    p AS (SELECT substr(b, 1, 6) AS b, sha256(string_agg(h, '' ORDER BY k)) AS h FROM h GROUP BY substr(b, 1, 6)),
    q AS (SELECT substr(b, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY b)) AS h FROM p GROUP BY substr(b, 1, 3))
    SELECT substr(sha256(string_agg(h, '' ORDER BY b)), 1, 12) AS fingerprint FROM q""")
def deep_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of whole documents by a tree of two levels, as tables of over 16 million rows have."""
    return metrics.fingerprint(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), levels=2)


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'epts' WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'pts' END AS doc_type FROM orders WHERE o_orderkey % 5 <> 0""")
def result_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by which results of one variant are stored: the predicted one, else the label's."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    records = orders.select(
        k.cast("string").alias("id"), F.when(k % 5 == 0, "photo").otherwise("clean").alias("variant"), F.when(k % 3 == 0, EPTS).when(k % 2 == 0, "").alias("pred_doc_type"), F.create_map(F.lit("vin"), F.lit("X")).alias("fields")
    )
    items = orders.where(k % 7 != 0).select(k.cast("string").alias("id"), F.lit(PTS).alias("doc_type"))
    found = fill.documents_of_results(records, items, "clean").select("id", F.nullif("doc_type", F.lit("")).alias("doc_type"))
    return found


@query("""
    WITH a AS (SELECT 'vlm_m' || CAST(l_suppkey % 3 AS VARCHAR) AS engine, 'f' || CAST(l_partkey % 20 AS VARCHAR) AS key, avg(l_discount) AS accuracy FROM lineitem WHERE (l_suppkey % 3 + l_partkey % 20) % 4 <> 0 GROUP BY 1, 2),
    b AS (SELECT key, max(accuracy) AS best FROM a GROUP BY key), e AS (SELECT DISTINCT engine FROM a)
    SELECT b.key, e.engine, round(coalesce(a.accuracy, 0), 9) AS accuracy, round(best, 9) AS best FROM b CROSS JOIN e LEFT JOIN a ON a.key = b.key AND a.engine = e.engine""")
def field_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a chart by field: each engine's accuracy (0 where it has none) and the best of all engines."""
    engine, key = F.col("l_suppkey") % 3, F.col("l_partkey") % 20
    rows = table(spark, sf_dir, "lineitem").where((engine + key) % 4 != 0)
    shares = rows.groupBy(F.concat(F.lit("vlm_m"), engine.cast("string")).alias("engine"), F.concat(F.lit("f"), key.cast("string")).alias("key")).agg(F.avg("l_discount").alias("accuracy"))
    return metrics.field_chart(shares).withColumns({c: F.round(c, 9) for c in ("accuracy", "best")})


@query("""
    SELECT count(DISTINCT o_custkey) AS vehicles, count(*) AS documents, CAST(sum(o_orderkey % 4) AS BIGINT) AS boxes, count(*) FILTER (o_orderkey % 3 = 0) AS test FROM orders""")
def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct vehicles, documents, boxes and documents of the test part."""
    k = F.col("o_orderkey")
    boxes = F.map_from_entries(F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda n: n <= k % 4), lambda n: F.struct(n.cast("string"), F.array(n, n, n, n))))
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("vehicle_id"), F.when(k % 3 == 0, "test").otherwise("dev").alias("split"), boxes.alias("boxes"))
    return metrics.dataset_counts(items)


@query("""
    SELECT c_custkey, concat_ws(' ', CASE WHEN c_custkey % 3 <> 0 THEN c_name END, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END) AS owner,
           '{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_mktsegment":"' || c_mktsegment || '"}' AS json
    FROM customer""")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a found card in one line, empty ones left out, and a card as JSON to download."""
    k = F.col("c_custkey")
    cards = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(k % 3 != 0, F.col("c_name")).alias("last"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("first"))
    return cards.select("c_custkey", in_one_line("last", "first").alias("owner"), as_json(["c_custkey", "c_mktsegment"]).alias("json"))


@query("""
    SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Qwen3-VL 8B' WHEN 1 THEN 'Qwen2.5-VL' WHEN 2 THEN 'own-' || CAST(s_suppkey AS VARCHAR) WHEN 3 THEN 'Tesseract 5 + правила' ELSE s_name END AS label FROM supplier""")
def engine_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, "vlm_qwen3-vl-8b").when(k % 5 == 1, "vlm_Qwen2.5VL").when(k % 5 == 2, F.concat(F.lit("vlm_own-"), k.cast("string"))).when(k % 5 == 3, "tesseract").otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", metrics.engine_label(name).alias("label"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_counts(table(spark, sf_dir, "events"), "ts", "event_type")
