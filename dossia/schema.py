"""Document types, fields and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STS_FRONT, STS_BACK, PTS, EPTS = "sts_front", "sts_back", "pts", "epts"
DOC_TYPES = [STS_FRONT, STS_BACK, PTS, EPTS]

# Document titles, fields (key, title, kind) and the fields of each document type.
DOC_TITLES = {
    STS_FRONT: "СТС, лицевая сторона",
    STS_BACK: "СТС, оборот",
    PTS: "ПТС (бумажный)",
    EPTS: "Выписка из ЭПТС",
}
FIELDS = [
    ("doc_number", "Серия и номер документа", "code"),
    ("plate", "Регистрационный знак", "code"),
    ("vin", "VIN", "code"),
    ("make_model", "Марка, модель", "text"),
    ("vehicle_type", "Тип ТС", "text"),
    ("category", "Категория", "text"),
    ("year", "Год выпуска", "int"),
    ("engine_model", "Модель и номер двигателя", "text"),
    ("chassis", "Шасси (рама) №", "text"),
    ("body", "Кузов (кабина, прицеп) №", "code"),
    ("color", "Цвет", "text"),
    ("power_kw", "Мощность, кВт", "int"),
    ("power_hp", "Мощность, л.с.", "int"),
    ("engine_volume", "Рабочий объём, см³", "int"),
    ("engine_type", "Тип двигателя", "text"),
    ("eco_class", "Экологический класс", "text"),
    ("max_mass", "Разрешённая макс. масса, кг", "int"),
    ("curb_mass", "Масса без нагрузки, кг", "int"),
    ("manufacturer", "Изготовитель", "text"),
    ("pts_number", "ПТС (серия, номер)", "code"),
    ("owner_last", "Фамилия собственника", "text"),
    ("owner_first", "Имя собственника", "text"),
    ("owner_middle", "Отчество собственника", "text"),
    ("region", "Регион", "text"),
    ("city", "Населённый пункт", "text"),
    ("street_address", "Улица, дом, кв.", "text"),
    ("gibdd_code", "Код подразделения ГИБДД", "code"),
    ("issue_date", "Дата выдачи", "date"),
    ("epts_status", "Статус ЭПТС", "text"),
]
DOC_FIELDS = {
    STS_FRONT: [
        "plate", "vin", "make_model", "vehicle_type", "category", "year", "chassis", "body", "color", "power_kw", "power_hp", "eco_class",
        "pts_number", "max_mass", "curb_mass", "doc_number",
    ],
    STS_BACK: ["owner_last", "owner_first", "owner_middle", "region", "city", "street_address", "gibdd_code", "issue_date", "doc_number"],
    PTS: [
        "vin", "make_model", "vehicle_type", "category", "year", "engine_model", "chassis", "body", "color", "power_kw", "power_hp", "engine_volume",
        "engine_type", "eco_class", "max_mass", "curb_mass", "manufacturer", "owner_last", "owner_first", "owner_middle", "region", "city",
        "street_address", "issue_date", "doc_number",
    ],
    EPTS: [
        "doc_number", "epts_status", "vin", "make_model", "category", "year", "color", "power_kw", "power_hp", "engine_volume", "engine_type",
        "eco_class", "max_mass", "manufacturer", "owner_last", "owner_first", "owner_middle", "region", "issue_date",
    ],
}
# Columns of a vehicle card, those that hold whole numbers, and those that link documents.
CARD_COLUMNS = [
    "vin", "plate", "sts_number", "pts_number", "make_model", "vehicle_type", "category", "year", "color", "power_kw", "power_hp", "engine_volume",
    "engine_type", "eco_class", "max_mass", "curb_mass", "manufacturer", "owner_last", "owner_first", "owner_middle", "region", "city",
    "street_address",
]
CARD_INTEGERS = ["year", "power_kw", "power_hp", "engine_volume", "max_mass", "curb_mass"]
LINK_KEYS = ["vin", "sts_number", "pts_number"]

KEYS = [k for k, _, _ in FIELDS]
KIND = {k: kind for k, _, kind in FIELDS}
TITLE = {k: title for k, title, _ in FIELDS}

# Schemas as text: executors import this module too.
ITEM = (
    "id string, vehicle_id string, doc_type string, split string, image string, photo string, width int, height int, "
    "fields map<string,string>, boxes map<string,array<int>>"
)
RECORD = "id string, variant string, doc_type string, pred_doc_type string, fields map<string,string>, seconds double, error string"
CARD = "id bigint, " + ", ".join(f"{c} {'int' if c in CARD_INTEGERS else 'string'}" for c in CARD_COLUMNS) + ", updated timestamp"
CHECK = "array<struct<level:string,field:string,message:string>>"
STORE_DOCUMENT = f"id bigint, vehicle_id bigint, doc_type string, source string, engine string, created timestamp, fields map<string,string>, checks {CHECK}"


def field_dim(spark: SparkSession) -> DataFrame:
    """key, title, kind, ord of each field."""
    return spark.createDataFrame([(*f, n) for n, f in enumerate(FIELDS)], "key string, title string, kind string, ord int")


def doc_field(spark: SparkSession) -> DataFrame:
    """doc_type, key, pos: the fields that each document type has."""
    return spark.createDataFrame([(t, k, n) for t in DOC_TYPES for n, k in enumerate(DOC_FIELDS[t])], "doc_type string, key string, pos int")


def doc_type_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, DOC_TITLES[t], n) for n, t in enumerate(DOC_TYPES)], "doc_type string, title string, ord int")
