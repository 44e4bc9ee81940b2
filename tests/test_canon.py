import datetime as dt

import pytest
from pyspark.sql import functions as F

from dossia.functions import canon as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("key", "raw", "want"),
    [
        ("plate", "a123bc 164", "А123ВС164"),
        ("plate", "0123ВС64", "О123ВС64"),
        ("plate", "АО2ЗВС164", "А023ВС164"),
        ("vin", "xta 21170O k1234567", "XTA211700K1234567"),
        ("vin", "хта 21170О к1234567", "XTA211700K1234567"),
        ("doc_number", "99 01 123456", "9901123456"),
        ("doc_number", "63 OX 123456", "63ОХ123456"),
        ("pts_number", "63 0Х 123456", "63ОХ123456"),
        ("issue_date", "1.2.2020", "01.02.2020"),
        ("power_hp", "106 л.с.", "106"),
        ("power_hp", "007", "7"),
        ("city", "Г. САРАТОВ", "ГСАРАТОВ"),
        ("city", "г.Саратов", "ГСАРАТОВ"),
        ("body", "Отсутствует", "ОТСУТСТВУЕТ"),
        ("gibdd_code", "116 4-001", "1164001"),
        ("color", None, ""),
        ("color", "нет данных", ""),
        ("color", "ёлка  cеpая;", "ЕЛКАСЕРАЯ"),
    ],
)
def test_canon(spark, key, raw, want):
    assert one(spark, C.canon(key, F.lit(raw).cast("string"))) == want
    assert one(spark, C.canon_of_base(F.lit(key), C.base(F.lit(raw).cast("string")))) == want


def test_error_rate(spark):
    rate = lambda p, t: one(spark, C.cer(F.lit(p), F.lit(t)))
    assert rate("ABC", "ABC") == 0 and rate("", "ABC") == 1 and rate("", "") == 0 and rate("A", "") == 1
    assert 0 < rate("XTA211700K1234568", "XTA211700K1234567") < 0.1
    assert rate("ABCDEFGH", "A") == 1


def test_vin_digit_and_years(spark):
    assert one(spark, C.vin_check_digit(F.lit("1M8GDM9AXKP042788"))) == "X"
    codes = {y: one(spark, C.vin_year_code(F.lit(y))) for y in (2000, 2001, 2009, 2010, 2018, 2030, 2031)}
    assert codes == {2000: None, 2001: "1", 2009: "9", 2010: "A", 2018: "J", 2030: "Y", 2031: None}


def test_dates_and_numbers(spark):
    assert one(spark, C.date_value(F.lit("выдан 3-4-2019"))) == dt.date(2019, 4, 3)
    assert one(spark, C.date_value(F.lit("31.02.2019"))) is None
    assert one(spark, C.int_value(F.lit("106 (78)"))) == 10678
    assert one(spark, C.int_value(F.lit("-"))) is None
    assert [one(spark, C.docs_word(F.lit(n))) for n in (1, 2, 5, 11, 12, 21, 111)] == ["документ", "документа", "документов", "документов", "документов", "документ", "документов"]


def test_halves_of_kilowatts_go_to_even(spark):
    assert [one(spark, C.hp_to_kw(F.lit(n))) for n in (0, 106, 1000, 3000, 11000, 43000, 87000)] == [0, 78, 736, 2206, 8090, 31626, 63988]
    assert one(spark, C.hp_to_kw(F.lit(11000.0))) == 8090 and one(spark, C.hp_to_kw(F.lit(None).cast("bigint"))) is None


def test_clean_fields(spark):
    raw = F.create_map(*map(F.lit, ["vin", "хта21170ок1234567", "color", " cеpый.", "city", "", "make_model", "КIА rio"]))
    assert one(spark, C.clean_fields(raw)) == {"vin": "XTA211700K1234567", "color": "СЕРЫЙ", "make_model": "KIA RIO"}
