"""The library's functions under names that SQL can use. Each is a SQL function whose body is the column expression, so Catalyst sees through it."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from dossia.functions import canon as C
from dossia.schema import KIND


_LITERAL = re.compile(r"('(?:[^'\\]|\\.)*')", re.DOTALL)
_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|!=|[=%+*/<>!-]|and|or)(?=\()")


def sql_text(column: Column) -> str:
    """A column expression as SQL. Operators come as calls of functions of their names, which SQL wants quoted."""
    parts = _LITERAL.split(column._jc.node().sql())
    return "".join(x if k % 2 else _OPERATOR.sub(r"`\1`", x) for k, x in enumerate(parts))


def _functions() -> dict[str, tuple[str, str, Column]]:
    """name: (parameters, type, expression over the parameters)."""
    s, p, t = F.col("s"), F.col("p"), F.col("t")
    out = {f"canon_{key}": ("s STRING", "STRING", C.canon(key, s)) for key in KIND}
    return out | {
        "base_text": ("s STRING", "STRING", C.base(s)),
        "cer": ("p STRING, t STRING", "DOUBLE", C.cer(p, t)),
        "int_value": ("s STRING", "BIGINT", C.int_value(s).cast("bigint")),
        "date_value": ("s STRING", "DATE", C.date_value(s).cast("date")),
        "vin_check_digit": ("s STRING", "STRING", C.vin_check_digit(s)),
        "vin_year_code": ("y INT", "STRING", C.vin_year_code(F.col("y"))),
        "hp_to_kw": ("hp DOUBLE", "DOUBLE", C.hp_to_kw(F.col("hp")).cast("double")),
        "safe_name": ("s STRING", "STRING", C.safe_name(s)),
        "norm_label": ("s STRING", "STRING", C.norm_label(s)),
        "docs_word": ("n BIGINT", "STRING", C.docs_word(F.col("n"))),
        "percent_text": ("x DOUBLE", "STRING", C.percent_text(F.col("x"))),
    }


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes the functions known to the session; their names. ``canon_<field>`` takes a value's text to the form in which values of that field are compared."""
    names = []
    for name, (parameters, kind, column) in _functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {sql_text(column)}")
        names.append(prefix + name)
    return names


def register_phrases(spark: SparkSession, name: str = "phrase_conditions") -> None:
    """A table function: column, op, value (array of strings) of the conditions that the rules find in a phrase; words are left to ``parse_phrases``.

    ``SELECT p.id, c.* FROM phrases p, LATERAL phrase_conditions(p.text) c``
    """
    from dossia.plans.phrases import rule_steps, started

    start, conds = started(F.col("phrase"))
    rows = f"SELECT {sql_text(start)} AS rest, {sql_text(conds)} AS conds"
    for conds, rest in rule_steps():
        rows = f"SELECT {sql_text(rest)} AS rest, {sql_text(conds)} AS conds FROM ({rows})"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(phrase STRING) RETURNS TABLE (`column` STRING, op STRING, value ARRAY<STRING>) "
        f"RETURN SELECT c.`column`, c.op, c.value FROM (SELECT explode(conds) AS c FROM ({rows}))"
    )
