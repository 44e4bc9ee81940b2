"""Printed lines of documents: tokens with places become labels and values, and these become fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import pandas_udf

from dossia.functions.canon import norm_label
from dossia.schema import EPTS, PTS, STS_BACK, STS_FRONT

# The labels printed on each document type, and words that tell the types apart.
LABELS = {
    STS_FRONT: {
        "plate": "регистрационный знак", "vin": "идентификационный номер vin", "make_model": "марка модель", "vehicle_type": "тип тс",
        "category": "категория тс a b c d прицеп", "year": "год выпуска тс", "chassis": "шасси рама", "body": "кузов кабина прицеп", "color": "цвет",
        "power_kw_hp": "мощность двигателя квт лс", "eco_class": "экологический класс", "pts_number": "паспорт тс серия",
        "max_mass": "разрешенная max масса кг", "curb_mass": "масса без нагрузки кг",
    },
    STS_BACK: {
        "owner_last": "фамилия", "owner_first": "имя", "owner_middle": "отчество", "region": "республика край область", "city": "населенный пункт",
        "street_address": "улица дом корп кв", "gibdd_code": "код подразделения гибдд", "issue_date": "дата выдачи",
    },
    PTS: {
        "vin": "1 идентификационный номер vin", "make_model": "2 марка модель тс", "vehicle_type": "3 наименование тип тс",
        "category": "4 категория тс a b c d прицеп", "year": "5 год изготовления тс", "engine_model": "6 модель двигателя", "chassis": "7 шасси рама",
        "body": "8 кузов кабина прицеп", "color": "9 цвет кузова кабины прицепа", "power_hp_kw": "10 мощность двигателя лс квт",
        "engine_volume": "11 рабочий объем двигателя куб см", "engine_type": "12 тип двигателя", "eco_class": "13 экологический класс",
        "max_mass": "14 разрешенная max масса кг", "curb_mass": "15 масса без нагрузки кг", "manufacturer": "16 организация изготовитель тс страна",
        "_approval": "17 одобрение типа тс", "_country": "18 страна вывоза тс", "_customs_doc": "19 серия тд тпо", "_customs": "20 таможенные ограничения",
        "owner_full": "21 наименование фио собственника тс", "address": "22 адрес", "_issuer": "23 наименование организации выдавшей паспорт",
        "issue_date": "24 дата выдачи паспорта",
    },
    EPTS: {
        "doc_number": "номер электронного паспорта", "epts_status": "статус электронного паспорта", "issue_date": "дата оформления",
        "vin": "идентификационный номер vin", "make_model": "марка коммерческое наименование", "category": "категория", "year": "год изготовления",
        "color": "цвет", "engine_volume": "рабочий объем цилиндров см3", "power_kw_hp": "максимальная мощность квт лс", "engine_type": "тип двигателя",
        "eco_class": "экологический класс", "max_mass": "технически допустимая макс масса кг", "manufacturer": "изготовитель", "owner_last": "фамилия",
        "owner_first": "имя", "owner_middle": "отчество", "region": "субъект российской федерации",
    },
}
KEYWORDS = {
    EPTS: ["ВЫПИСКА", "ЭЛЕКТРОННОГО ПАСПОРТА"],
    PTS: ["ПАСПОРТ ТРАНСПОРТНОГО СРЕДСТВА", "ОДОБРЕНИЕ ТИПА", "ТАМОЖЕННЫЕ"],
    STS_BACK: ["СОБСТВЕННИК (ВЛАДЕЛЕЦ)", "ОСОБЫЕ ОТМЕТКИ", "КОД ПОДРАЗДЕЛЕНИЯ"],
    STS_FRONT: ["РЕГИСТРАЦИОННЫЙ ЗНАК", "ЭКОЛОГИЧЕСКИЙ КЛАСС", "СВИДЕТЕЛЬСТВО О РЕГИСТРАЦИИ"],
}
LINE = ["doc_id", "block", "par", "line"]


def lcs_ratio(a: str | None, b: str | None) -> float:
    """100 * 2 * longest common subsequence / total length; 100 for two empty texts."""
    a, b = a or "", b or ""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for n, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << n
    # One bit for each character of a; a bit that becomes 0 is one more character of the subsequence.
    whole = (1 << len(a)) - 1
    free = whole
    for y in b:
        met = free & places.get(y, 0)
        free = (free + met | free - met) & whole
    return 200.0 * (len(a) - free.bit_count()) / (len(a) + len(b))


def lcs_ratio_udf(a: str, b: str) -> Column:
    """lcs_ratio of two columns; Spark has no built-in for it."""

    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs_ratio(*p) for p in zip(x, y, strict=True)], dtype=float)

    return pandas_udf(ratios, "double")(a, b)


def split_lines(words: DataFrame) -> DataFrame:
    """One row per printed line: text, label, tokens (array of the value's tokens), value.

    A line that starts right of 30 % of the page is all value; else the value starts after the first gap wider than 1.8 times the upper median
    height of the line's tokens, 28 pixels at least.
    """
    token = F.struct(F.col("left").cast("int").alias("left"), F.col("text").alias("text"), (F.col("left") + F.col("width")).cast("int").alias("right"), F.col("height").cast("int").alias("height"))
    lines = words.groupBy(*LINE).agg(F.first("page_width").alias("page_width"), F.array_sort(F.collect_list(token)).alias("t"))
    heights = F.array_sort(F.transform("t", lambda x: x["height"]))
    limit = F.greatest(F.lit(28.0), F.element_at(heights, (F.floor(F.size("t") / 2) + 1).cast("int")) * 1.8)
    lines = lines.withColumn("limit", limit)
    n = F.size("t")
    gaps = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: (i < n) & (F.element_at("t", F.least(i + 1, n))["left"] - F.element_at("t", i)["right"] > F.col("limit")))
    at = F.when(F.element_at("t", 1)["left"] > F.col("page_width") * 0.3, 0).otherwise(F.coalesce(F.get(gaps, 0), n))
    lines = lines.withColumn("at", at.cast("int"))
    join = lambda xs: F.array_join(F.transform(xs, lambda x: x["text"]), " ")
    tokens = F.filter("t", lambda x, i: i >= F.col("at"))
    return lines.select(
        *LINE, join(F.col("t")).alias("text"), norm_label(join(F.filter("t", lambda x, i: i < F.col("at")))).alias("label"), tokens.alias("tokens"), clean_value_tokens(tokens).alias("value")
    )


def clean_value_tokens(tokens: Column) -> Column:
    """The first unbroken run of tokens in capitals or digits: small letters or a gap wider than 3.2 heights end it."""
    kind = tokens_type()
    start = F.struct(F.array().cast(kind).alias("kept"), F.lit(False).alias("over"))

    def step(state: Column, w: Column) -> Column:
        small, useful = w["text"].rlike("[a-zа-яё]"), w["text"].rlike("[A-ZА-ЯЁ0-9]")
        some = F.size(state["kept"]) > 0
        last = F.element_at(state["kept"], -1)
        far = some & (w["left"] - last["right"] > F.greatest(last["height"], w["height"], F.lit(10)) * 3.2)
        ends = state["over"] | (some & (small | (useful & far)))
        keeps = ~ends & ~small & useful
        kept = F.when(keeps, F.concat(state["kept"], F.array(w))).otherwise(state["kept"])
        return F.struct(kept.alias("kept"), ends.alias("over"))

    run = F.aggregate(tokens, start, step, lambda s: s["kept"])
    return F.btrim(F.array_join(F.transform(run, lambda x: x["text"]), " "), F.lit(" =|‚,"))


def tokens_type() -> str:
    return "array<struct<left:int,text:string,right:int,height:int>>"


def label_dim(spark) -> DataFrame:
    """doc_type, key, printed: a few dozen rows."""
    return spark.createDataFrame([(t, k, label) for t, labels in LABELS.items() for k, label in labels.items()], "doc_type string, key string, printed string")


def near_labels(lines: DataFrame, least: float) -> DataFrame:
    """label, near (array of doc_type, key, ratio): the printed labels that each distinct label is near to. Each is compared once, however many lines hold it."""
    labels = F.array(*[F.struct(F.lit(t).alias("doc_type"), F.lit(k).alias("key"), F.lit(x).alias("printed")) for t, ls in LABELS.items() for k, x in ls.items()])
    pairs = lines.where("label <> ''").select("label").distinct().select("label", F.inline(labels))
    size = F.length("label") + F.length("printed")
    possible = pairs.where(F.least(F.length("label"), F.length("printed")) * 200 >= size * least)  # no ratio is higher than that of the lengths
    rated = possible.withColumn("ratio", lcs_ratio_udf("label", "printed")).where(F.col("ratio") >= least)
    return rated.groupBy("label").agg(F.collect_list(F.struct("doc_type", "key", "ratio")).alias("near"))  # a few dozen at most


def doc_types(lines: DataFrame) -> DataFrame:
    """doc_id, doc_type by vote: 2 for each keyword in the text, 1 for each line whose best label is near (80); ties go to the first type in KEYWORDS."""
    order = list(KEYWORDS)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "text"))), lambda x: x["text"]), "\n")
    whole = lines.groupBy("doc_id").agg(F.translate(F.upper(text), "Ё", "Е").alias("text"))
    words = F.array(*[F.struct(F.lit(t).alias("doc_type"), sum((F.when(F.col("text").contains(k), 2).otherwise(0) for k in KEYWORDS[t]), F.lit(0)).alias("n")) for t in order])
    by_word = whole.select("doc_id", F.inline(words))
    met = lines.select(*LINE, "label").join(near_labels(lines, 80), "label")
    near = met.select(*LINE, F.explode(F.array_distinct(F.transform("near", lambda x: x["doc_type"]))).alias("doc_type"))
    votes = by_word.unionByName(near.select("doc_id", "doc_type", F.lit(1).alias("n"))).groupBy("doc_id", "doc_type").agg(F.sum("n").alias("n"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("doc_type"))
    return votes.groupBy("doc_id").agg(F.max(F.struct("n", (-place).alias("p"), "doc_type"))["doc_type"].alias("doc_type"))


def labelled_values(lines: DataFrame, types: DataFrame) -> DataFrame:
    """doc_id, doc_type, key, value, next_value: the best line for each label, from 70 on; short labels need 80."""
    order = W.partitionBy("doc_id").orderBy("block", "par", "line")
    after = F.when(F.lead("label").over(order) == "", F.nullif(F.lead("value").over(order), F.lit("")))
    rows = lines.withColumn("next_value", after).where("label <> '' and value <> ''").join(types, "doc_id")
    met = rows.join(near_labels(lines, 70), "label")
    of_type = F.filter("near", lambda x: x["doc_type"] == F.col("doc_type"))
    best = met.withColumn("b", F.array_max(F.transform(of_type, lambda x: F.struct(x["ratio"].alias("ratio"), x["key"].alias("key"))))).where("b is not null")
    best = best.select(*LINE, "doc_type", "value", "next_value", "b.key", (F.col("b.ratio") - F.when(F.length("label") <= 6, 10).otherwise(0)).alias("score"))
    first = W.partitionBy("doc_id", "key").orderBy(F.desc("score"), "block", "par", "line")
    best = best.where("score >= 70").withColumn("n", F.row_number().over(first)).where("n = 1")
    return best.select("doc_id", "doc_type", "key", "value", "next_value")


def fields_of_values(values: DataFrame) -> DataFrame:
    """doc_id, doc_type, fields: values put under the keys that their labels stand for."""
    v = F.col("value")
    numbers = F.regexp_extract_all(v, F.lit(r"(\d+)"), 1)
    names = F.filter(F.split(F.translate(v, ",", " "), " +"), lambda x: x != "")
    longest = F.get(F.array_sort(numbers, lambda a, b: F.length(b) - F.length(a)), 0)
    pair = lambda a, b: F.when(F.size(numbers) >= 2, F.array(F.struct(F.lit(a).alias("k"), numbers[0].alias("v")), F.struct(F.lit(b).alias("k"), numbers[1].alias("v"))))
    entry = lambda k, x: F.struct(F.lit(k).alias("k"), x.alias("v"))
    city = F.when(v.contains(","), F.btrim(F.regexp_replace(v, "^[^,]*,", ""))).otherwise("")
    parts = (
        F.when(F.col("key").startswith("_"), F.array().cast("array<struct<k:string,v:string>>"))
        .when(F.col("key") == "power_kw_hp", pair("power_kw", "power_hp"))
        .when(F.col("key") == "power_hp_kw", pair("power_hp", "power_kw"))
        .when(F.col("key") == "owner_full", F.array(*[entry(k, F.get(names, n)) for n, k in enumerate(("owner_last", "owner_first", "owner_middle"))]))
        .when(F.col("key") == "address", F.array(entry("region", F.btrim(F.substring_index(v, ",", 1))), entry("city", city), entry("street_address", F.col("next_value"))))
        .when(F.col("key").isin("year", "max_mass", "curb_mass", "engine_volume", "gibdd_code"), F.array(F.struct(F.col("key").alias("k"), longest.alias("v"))))
        .otherwise(F.array(F.struct(F.col("key").alias("k"), v.alias("v"))))
    )
    long = values.select("doc_id", "doc_type", F.explode(parts).alias("e")).select("doc_id", "doc_type", "e.*").where("v is not null")
    one = long.groupBy("doc_id", "doc_type", "k").agg(F.max("v").alias("v"))
    return one.groupBy("doc_id", "doc_type").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields"))


def best_pass(first: Column, second: Column, expected: Column) -> Column:
    """Fields of two passes: the second counts only if the first found under 75 % of the expected ones; the larger wins, the other fills gaps."""
    merged = lambda a, b: F.map_concat(a, F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)))
    both = F.when(F.size(second) > F.size(first), merged(second, first)).otherwise(merged(first, second))
    return F.when(F.size(first) < expected * 0.75, both).otherwise(first)


def regex_fallbacks(fields: Column, doc_type: Column, text: Column) -> Column:
    """Numbers found by their form where no label gave them; a number found so on a certificate (the last one) or passport (the first one) counts over a labelled one."""
    up = F.upper(text)
    spaced = lambda m, p: F.regexp_replace(m, p, "$1 $2 $3")
    sts, pts = r"(\d{2})\s?(\d{2})\s?(\d{6})", r"(\d{2})\s?([А-ЯA-Z0]{2})\s?(\d{6})"
    whole = lambda p: F.regexp_extract_all(up, F.lit(rf"(?U)(?<!\d){p}(?!\d)"), 0)
    number = F.when(doc_type.isin(STS_FRONT, STS_BACK), spaced(F.try_element_at(whole(sts), F.lit(-1)), sts)).when(doc_type == PTS, spaced(F.get(whole(pts), 0), pts))
    vin = F.when(doc_type != STS_BACK, F.nullif(F.regexp_extract(up, r"(?U)\b[A-HJ-NPR-Z0-9]{17}\b", 0), F.lit("")))
    date = F.when(doc_type.isin(STS_BACK, PTS, EPTS), F.try_element_at(F.regexp_extract_all(up, F.lit(r"\d{2}\.\d{2}\.\d{4}"), 0), F.lit(-1)))
    labelled = lambda k: F.element_at(fields, k)
    found = {"doc_number": F.coalesce(number, labelled("doc_number")), "vin": F.coalesce(labelled("vin"), vin), "issue_date": F.coalesce(labelled("issue_date"), date)}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in found.items()])
    rest = F.map_filter(fields, lambda k, v: ~k.isin(*found))
    return F.map_concat(rest, F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))


def read_documents(words: DataFrame) -> DataFrame:
    """doc_id, doc_type, fields, text of printed pages: lines, the type by vote, labelled values, and numbers found by their form.

    Documents without any label that is near to a printed one have no row. A null address line counts as none.
    """
    lines = split_lines(words)
    found = fields_of_values(labelled_values(lines, doc_types(lines)))
    place = F.struct("block", "par", "line", "text")
    texts = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["text"]), "\n").alias("text"))
    return found.join(texts, "doc_id").select("doc_id", "doc_type", regex_fallbacks(F.col("fields"), F.col("doc_type"), F.col("text")).alias("fields"), "text")


def nearest_by_edits(text: Column, labels: list[str]) -> Column:
    """label, distance: the label with the fewest edits to a text, of equally near ones the last by name."""
    each = [F.struct((-F.levenshtein(text, F.lit(label))).alias("d"), F.lit(label).alias("label")) for label in labels]
    best = F.array_max(F.array(*each))
    return F.struct(best["label"].alias("label"), (-best["d"]).alias("distance"))
