"""Model answers as text: the JSON object in them, and what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.functions.canon import clean_fields
from dossia.operators.quality import detect_doc_type
from dossia.schema import DOC_FIELDS, DOC_TYPES, KEYS, TITLE

_MAP = "map<string,string>"


def json_object(answer: Column) -> Column:
    """The first candidate that is a JSON object: a fenced one, else from the first brace to the last; thoughts are left out. Null if none is."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parses = lambda c: F.when(F.from_json(c, _MAP).isNotNull() & (c != ""), c)
    return F.coalesce(parses(fenced), parses(outer))


def extraction(answers: DataFrame, id_col: str = "id", answer_col: str = "answer") -> DataFrame:
    """id, doc_type, fields (cleaned, known keys only), error of each answer."""
    top = F.from_json(json_object(F.col(answer_col)), _MAP)
    inner = F.from_json(F.element_at("top", "fields"), _MAP)
    df = answers.select(F.col(id_col).alias("id"), top.alias("top"))
    named = F.map_filter(F.coalesce(inner, F.col("top")), lambda k, v: k.isin(KEYS) & v.isNotNull())
    df = df.select("id", "top", clean_fields(named).alias("fields"))
    said = F.element_at("top", "doc_type")
    kind = F.when(said.isin(DOC_TYPES), said).otherwise(detect_doc_type(F.col("fields")))
    none = F.create_map().cast(_MAP)
    return df.select(
        "id",
        kind.alias("doc_type"),
        F.coalesce("fields", none).alias("fields"),
        F.when(F.col("top").isNull(), "answer is not JSON").alias("error"),
    )


def prompt() -> str:
    """What a model is asked: document types, and each type's fields by name."""
    lines = [f"{t}: " + ", ".join(f"{k} ({TITLE[k]})" for k in keys) for t, keys in DOC_FIELDS.items()]
    return "Верни JSON с ключами doc_type и fields.\n" + "\n".join(lines)


def answer_schema() -> dict:
    """JSON schema of an answer."""
    fields = {"type": "object", "properties": {k: {"type": "string"} for k in KEYS}}
    return {
        "type": "object",
        "properties": {"doc_type": {"type": "string", "enum": DOC_TYPES}, "fields": fields},
        "required": ["doc_type", "fields"],
    }
