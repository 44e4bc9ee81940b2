"""Synthetic vehicles and their documents.

Each attribute of a vehicle is drawn from a hash of the seed, the vehicle's number and the attribute's name: a vehicle doesn't depend on the others,
on the number of them or on how the work is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.functions.canon import VIN_VALUES, bound, hp_to_kw, vin_check_digit, vin_year_code
from dossia.functions.regions import REGION_CODES
from dossia.schema import DOC_FIELDS, EPTS, PTS, STS_BACK, STS_FRONT

# Models with their maker's code, the years in which they were made, engine sizes in tenths of a litre, and mass in tens of kilograms.
MODELS = [
    ("LADA", "GRANTA", "XTA", 2012, 2024, [16], 112), ("LADA", "VESTA", "XTA", 2015, 2024, [16, 18], 125), ("LADA", "LARGUS", "XTA", 2012, 2023, [16], 130),
    ("KIA", "RIO", "Z94", 2011, 2022, [14, 16], 116), ("HYUNDAI", "SOLARIS", "Z94", 2011, 2022, [14, 16], 117), ("HYUNDAI", "CRETA", "Z94", 2016, 2022, [16, 20], 132),
    ("TOYOTA", "CAMRY", "XW7", 2011, 2022, [20, 25, 35], 152), ("TOYOTA", "RAV4", "XW7", 2013, 2022, [20, 25], 160), ("VOLKSWAGEN", "POLO", "XW8", 2011, 2022, [14, 16], 118),
    ("SKODA", "OCTAVIA", "XW8", 2013, 2022, [14, 16, 20], 130), ("RENAULT", "LOGAN", "X7L", 2014, 2022, [16], 110), ("RENAULT", "DUSTER", "X7L", 2012, 2022, [16, 20], 135),
    ("NISSAN", "QASHQAI", "Z8N", 2014, 2022, [12, 20], 138), ("CHERY", "TIGGO", "LVV", 2017, 2024, [15, 20], 145), ("HAVAL", "JOLION", "XZG", 2021, 2024, [15], 142),
    ("GEELY", "COOLRAY", "Y4K", 2020, 2024, [15], 134), ("MITSUBISHI", "OUTLANDER", "Z8T", 2013, 2022, [20, 24], 150), ("FORD", "FOCUS", "X9F", 2011, 2019, [16], 130),
]
SURNAMES = ["ИВАНОВ", "МОРОЗОВ", "ПЕТРОВ", "СМИРНОВ", "КУЗНЕЦОВ", "СОКОЛОВ", "ПОПОВ", "ВОЛКОВ", "ЗАЙЦЕВ", "ПАВЛОВ", "ОРЛОВ", "ЕГОРОВ"]
MEN, WOMEN = ["ИВАН", "ПЕТР", "АНДРЕЙ", "СЕРГЕЙ", "ПАВЕЛ"], ["АННА", "ОЛЬГА", "МАРИЯ", "ЕЛЕНА", "ИРИНА"]
FATHERS = ["ИВАНОВ", "ПЕТРОВ", "АНДРЕЕВ", "СЕРГЕЕВ", "ПАВЛОВ"]
COLORS = {"БЕЛЫЙ": 24, "ЧЕРНЫЙ": 18, "СЕРЫЙ": 15, "СЕРЕБРИСТЫЙ": 14, "СИНИЙ": 8, "КРАСНЫЙ": 7, "ТЕМНО-СЕРЫЙ": 5, "КОРИЧНЕВЫЙ": 4, "ЗЕЛЕНЫЙ": 3, "БЕЖЕВЫЙ": 2}
BODIES = {"ЛЕГКОВОЙ СЕДАН": 5, "ЛЕГКОВОЙ УНИВЕРСАЛ": 3, "ЛЕГКОВОЙ ХЭТЧБЕК": 2}
ENGINES = {"БЕНЗИНОВЫЙ": 94, "ДИЗЕЛЬНЫЙ": 6}
CITIES = {"САРАТОВСКАЯ ОБЛ": "САРАТОВ", "САМАРСКАЯ ОБЛ": "САМАРА", "ВОЛГОГРАДСКАЯ ОБЛ": "ВОЛГОГРАД", "РЕСП. ТАТАРСТАН": "КАЗАНЬ", "ПЕНЗЕНСКАЯ ОБЛ": "ПЕНЗА", "СВЕРДЛОВСКАЯ ОБЛ": "ЕКАТЕРИНБУРГ"}
STREETS, WAYS = ["ЛЕНИНА", "МИРА", "САДОВАЯ", "ШКОЛЬНАЯ", "ЛЕСНАЯ"], {"УЛ.": 4, "ПР-КТ": 1, "ПЕР.": 1}
PLATE_LETTERS = "АВЕКМНОРСТУХ"
#: The last day on which a document is issued.
TODAY = "2025-09-01"


def draw(seed: int, what: str, n: int | Column) -> Column:
    """A whole number from 0 to n - 1 for the attribute ``what`` of vehicle ``n``."""
    return F.pmod(F.xxhash64("n", F.lit(f"{seed}:{what}")), n if isinstance(n, Column) else F.lit(n)).cast("int")


def pick(options: list, seed: int, what: str) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), draw(seed, what, len(options)) + 1)


def weighted(options: dict[str, int], seed: int, what: str) -> Column:
    """One of some options, each as likely as its share of the weights."""
    spot, below, out = draw(seed, what, sum(options.values())), 0, None
    for value, weight in options.items():
        below += weight
        out = F.when(spot < below, value) if out is None else out.when(spot < below, value)
    return out


def models(spark: SparkSession) -> DataFrame:
    """m (a number from 0), brand, model, maker's code, first and last year, sizes in cubic centimetres, mass."""
    rows = [(n, b, m, w, y, z, [100 * x - 4 for x in sizes], 10 * mass) for n, (b, m, w, y, z, sizes, mass) in enumerate(MODELS)]
    return spark.createDataFrame(rows, "m int, brand string, model string, wmi string, first int, last int, sizes array<int>, mass int")


def vehicles(spark: SparkSession, count: int, seed: int = 42) -> DataFrame:
    """``count`` vehicles, all attributes as the text that their documents show; the same seed gives the same ones however the work is split."""
    d = lambda what, n: draw(seed, what, n)
    one_of = lambda chars, what: F.substring(F.lit(chars), d(what, len(chars)) + 1, F.lit(1))
    figures = lambda what, size: F.lpad(d(what, 10**size).cast("string"), size, "0")
    text = lambda c: c.cast("string")
    codes = [c for c in VIN_VALUES if not c.isdigit()]
    df = spark.range(count).withColumnRenamed("id", "n").withColumn("m", d("model", len(MODELS)))
    df = df.join(F.broadcast(models(spark)), "m")
    regions = [(r, c) for r in CITIES for c in REGION_CODES[r]]
    place = F.element_at(F.array(*[F.struct(*map(F.lit, r)) for r in regions]), d("region", len(regions)) + 1)
    year = F.col("first") + d("year", F.col("last") - F.col("first") + 1)
    woman = d("woman", 100) < 38
    df = df.withColumns({"year": year, "r": place, "size": F.element_at("sizes", d("size", F.size("sizes")) + 1), "woman": woman})
    df = df.withColumns({"region": F.col("r.col1"), "hp": (F.col("size") / 13 + d("tuned", 15)).cast("int"), "curb": F.col("mass") + d("mass", 12) * 5})
    # The place of the check digit holds it in 6 of 10 vehicles; the number of the vehicle makes each VIN its own.
    raw = F.concat("wmi", *[one_of("".join(codes), f"vin{k}") for k in range(5)], F.lit("0"), vin_year_code(F.col("year")), one_of("".join(codes), "plant"), F.lpad((F.col("n") % 1_000_000).cast("string"), 6, "0"))
    df = df.withColumn("raw", raw)
    check = F.when(d("checked", 10) < 6, vin_check_digit(F.col("raw"), bound)).otherwise(text(d("check", 10)))
    df = df.withColumn("vin", F.concat(F.substring("raw", 1, 8), check, F.substring("raw", 10, 8)))
    # Documents follow the year in which the car was made.
    made = F.make_date("year", d("month", 12) + 1, d("day", 28) + 1)
    today = F.lit(TODAY).cast("date")
    issued = lambda what, most: F.date_format(F.least(F.date_add(made, d(what, most)), F.greatest(today, made)), "dd.MM.yyyy")
    electronic = (F.col("year") >= 2021) | ((F.col("year") >= 2019) & (d("electronic", 10) < 3))
    paper = F.concat(F.lpad((d("pts1", 90) + 10).cast("string"), 2, "0"), F.lit(" "), one_of(PLATE_LETTERS, "pts2"), one_of(PLATE_LETTERS, "pts3"), F.lit(" "), F.lpad((F.col("n") % 1_000_000).cast("string"), 6, "0"))
    number = F.concat(F.lit("1643010"), F.lpad(F.col("n").cast("string"), 8, "0"))
    sts = F.concat(F.lpad((d("sts1", 90) + 10).cast("string"), 2, "0"), F.lit(" "), F.lpad((F.floor(F.col("n") / 1_000_000) % 90 + 10).cast("string"), 2, "0"), F.lit(" "), F.lpad((F.col("n") % 1_000_000).cast("string"), 6, "0"))
    ending = lambda man, woman: F.when(F.col("woman"), woman).otherwise(man)
    street = F.concat_ws(" ", weighted(WAYS, seed, "way"), F.concat(pick(STREETS, seed, "street"), F.lit(",")), F.lit("Д."), text(d("house", 180) + 1))
    flat = F.when(d("has_flat", 10) < 8, F.concat(F.lit(", КВ. "), text(d("flat", 240) + 1))).otherwise("")
    city = F.lit(None).cast("string")
    for region, name in CITIES.items():
        city = F.when(F.col("region") == region, f"Г. {name}").otherwise(city)
    return df.select(
        F.concat(F.lit("v"), F.lpad(F.col("n").cast("string"), 9, "0")).alias("vehicle_id"), "vin",
        F.concat(one_of(PLATE_LETTERS, "a"), F.lpad((d("d", 999) + 1).cast("string"), 3, "0"), one_of(PLATE_LETTERS, "b"), one_of(PLATE_LETTERS, "c"), "r.col2").alias("plate"),
        F.concat_ws(" ", "brand", "model").alias("make_model"), weighted(BODIES, seed, "body").alias("vehicle_type"), F.lit("B").alias("category"), text(F.col("year")).alias("year"),
        F.concat(F.lit("G"), text(F.col("size")), F.lit(", "), one_of("".join(codes), "e1"), figures("e2", 6)).alias("engine_model"), F.lit("ОТСУТСТВУЕТ").alias("chassis"), F.col("vin").alias("body"),
        weighted(COLORS, seed, "color").alias("color"), text(hp_to_kw(F.col("hp"))).alias("power_kw"), text(F.col("hp")).alias("power_hp"), text(F.col("size")).alias("engine_volume"),
        weighted(ENGINES, seed, "engine").alias("engine_type"), F.when(F.col("year") >= 2014, "ПЯТЫЙ").otherwise("ЧЕТВЕРТЫЙ").alias("eco_class"),
        text(F.col("curb") + (d("load", 31) + 80) * 5).alias("max_mass"), text(F.col("curb")).alias("curb_mass"), F.concat(F.lit("ООО «"), "brand", F.lit("» (РОССИЯ)")).alias("manufacturer"),
        F.concat(pick(SURNAMES, seed, "last"), ending("", "А")).alias("owner_last"), ending(pick(MEN, seed, "name"), pick(WOMEN, seed, "name")).alias("owner_first"),
        F.concat(pick(FATHERS, seed, "father"), ending("ИЧ", "НА")).alias("owner_middle"), "region", city.alias("city"), F.concat(street, flat).alias("street_address"),
        text(d("office", 100_000) + 1_100_000).alias("gibdd_code"), sts.alias("sts_number"), issued("sts_date", 3000).alias("sts_issue_date"), F.when(electronic, EPTS).otherwise(PTS).alias("pts_kind"),
        F.when(electronic, number).otherwise(paper).alias("pts_number"), issued("pts_date", 120).alias("pts_issue_date"), F.when(d("status", 100) < 93, "ДЕЙСТВУЮЩИЙ").otherwise("ПОГАШЕН").alias("epts_status"),
    )


def split_by(spot: Column, test_percent: int) -> Column:
    """``test`` for spots (0 to 99) below ``test_percent``, else ``dev``."""
    return F.when(spot < test_percent, "test").otherwise("dev")


def split_of(group: Column, test_percent: int = 30) -> Column:
    """``test`` or ``dev``, the same for all rows of a group."""
    return split_by(F.pmod(F.xxhash64(group), F.lit(100)), test_percent)


def documents(cars: DataFrame, test_percent: int = 30) -> DataFrame:
    """Three labelled documents of each vehicle: id, vehicle_id, doc_type, split (whole vehicles), fields (exactly those of the type, in its order)."""
    three = cars.withColumn("doc_type", F.explode(F.array(F.lit(STS_FRONT), F.lit(STS_BACK), "pts_kind")))
    certificate = F.col("doc_type").isin(STS_FRONT, STS_BACK)
    three = three.withColumns({"doc_number": F.when(certificate, F.col("sts_number")).otherwise(F.col("pts_number")), "issue_date": F.when(certificate, F.col("sts_issue_date")).otherwise(F.col("pts_issue_date"))})
    fields = F.lit(None).cast("map<string,string>")
    for kind, keys in DOC_FIELDS.items():
        fields = F.when(F.col("doc_type") == kind, F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))])).otherwise(fields)
    return three.select(F.concat_ws("_", "vehicle_id", "doc_type").alias("id"), "vehicle_id", "doc_type", split_of(F.col("vehicle_id"), test_percent).alias("split"), fields.alias("fields"))
