from dossia.operators import layout
from dossia.schema import PTS, STS_BACK


def lines(spark, rows):
    out = []
    for n, (doc, words) in enumerate(rows):
        for text, left in words:
            out.append((doc, 1000, 1, 1, n, text, left, 10 * n, 12 * len(text), 20))
    return spark.createDataFrame(out, "doc_id string, page_width int, block int, par int, line int, text string, left int, top int, width int, height int")


def test_reads_a_certificate(spark):
    words = lines(
        spark,
        [
            ("d", [("СОБСТВЕННИК", 0), ("(ВЛАДЕЛЕЦ)", 140)]),
            ("d", [("Фамилия", 0), ("ИВАНОВ", 300), ("мусор", 390)]),
            ("d", [("Имя", 0), ("ПЕТР", 300)]),
            ("d", [("Населенный", 0), ("пункт", 130), ("Г.", 300), ("САРАТОВ", 330)]),
            ("d", [("Дата", 0), ("выдачи", 60), ("01.02.2020", 300)]),
            ("d", [("99", 400), ("21", 430), ("123456", 460)]),
        ],
    )
    split = layout.split_lines(words)
    types = layout.doc_types(split)
    assert [r.doc_type for r in types.collect()] == [STS_BACK]
    (row,) = layout.fields_of_values(layout.labelled_values(split, types)).collect()
    assert row.fields == {"owner_last": "ИВАНОВ", "owner_first": "ПЕТР", "city": "Г. САРАТОВ", "issue_date": "01.02.2020"}


def test_pairs_addresses_and_numbers(spark):
    values = spark.createDataFrame(
        [("d", PTS, "power_hp_kw", "106 (78)", None), ("d", PTS, "owner_full", "ИВАНОВ, ПЕТР", None), ("d", PTS, "address", "САРАТОВСКАЯ ОБЛ, Г. САРАТОВ", "УЛ. ЛЕНИНА"), ("d", PTS, "year", "В 2015 Г 7", None), ("d", PTS, "_customs", "X", None)],
        "doc_id string, doc_type string, key string, value string, next_value string",
    )
    (row,) = layout.fields_of_values(values).collect()
    assert row.fields == {"power_hp": "106", "power_kw": "78", "owner_last": "ИВАНОВ", "owner_first": "ПЕТР", "region": "САРАТОВСКАЯ ОБЛ", "city": "Г. САРАТОВ", "street_address": "УЛ. ЛЕНИНА", "year": "2015"}


def test_fallbacks_and_passes(spark):
    from pyspark.sql import functions as F

    text = F.lit("серия 63 OX 123456 от 01.02.2019 и 03.04.2020 XTA211700K1234567")
    none = F.create_map().cast("map<string,string>")
    got = spark.range(1).select(layout.regex_fallbacks(none, F.lit(PTS), text).alias("f")).first().f
    assert got == {"doc_number": "63 OX 123456", "vin": "XTA211700K1234567", "issue_date": "03.04.2020"}
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    best = spark.range(1).select(layout.best_pass(m(a="1"), m(a="2", b="3"), F.lit(4)).alias("f"), layout.best_pass(m(a="1"), m(b="3"), F.lit(1)).alias("g")).first()
    assert best.f == {"a": "2", "b": "3"} and best.g == {"a": "1"}


def test_lcs_ratio():
    assert layout.lcs_ratio("abc", "abc") == 100 and layout.lcs_ratio("", "a") == 0 and layout.lcs_ratio("", None) == 100
    assert abs(layout.lcs_ratio("kitten", "sitting") - 100 * 2 * 4 / 13) < 1e-9
