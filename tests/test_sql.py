from pyspark.sql import functions as F

from dossia.functions import canon as C
from dossia.functions import sql


def test_functions_in_sql_give_what_columns_give(spark):
    names = sql.register(spark, "x_")
    assert "x_canon_plate" in names and "x_cer" in names
    rows = [("a123bc 164", "1.2.2020"), ("xta 21170O k1234567", "106 л.с."), ("it's \\ \"q\"", ""), (None, None)]
    df = spark.createDataFrame(rows, "s string, t string")
    df.createOrReplaceTempView("x_values")
    got = spark.sql("SELECT x_canon_plate(s) a, x_canon_vin(s) b, x_canon_issue_date(t) c, x_cer(s, t) d, x_vin_check_digit(s) e, x_canon_body(s) f, x_safe_name(s) g FROM x_values").collect()
    want = df.select(
        C.canon("plate", F.col("s")).alias("a"), C.canon("vin", F.col("s")).alias("b"), C.canon("issue_date", F.col("t")).alias("c"), C.cer(F.col("s"), F.col("t")).alias("d"),
        C.vin_check_digit(F.col("s")).alias("e"), C.canon("body", F.col("s")).alias("f"), C.safe_name(F.col("s")).alias("g"),
    ).collect()
    assert got == want


def test_text_of_literals_with_quotes(spark):
    column = F.when(F.col("s") == "a'b\\=(c", F.lit("yes -(x)")).otherwise(F.concat(F.col("s"), F.lit("\\'=(")))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION x_quoted(s STRING) RETURNS STRING RETURN {sql.sql_text(column)}")
    df = spark.createDataFrame([("a'b\\=(c",), ("z",)], "s string")
    df.createOrReplaceTempView("x_quotes")
    assert [r[0] for r in spark.sql("SELECT x_quoted(s) FROM x_quotes").collect()] == [r[0] for r in df.select(column).collect()]
