"""Plate codes of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Regions and the codes on their plates.
REGION_CODES = {
    "САРАТОВСКАЯ ОБЛ": ["64", "164"],
    "Г. МОСКВА": ["77", "97", "99", "177", "197", "199", "777", "797", "799", "977"],
    "МОСКОВСКАЯ ОБЛ": ["50", "90", "150", "190", "750"],
    "Г. САНКТ-ПЕТЕРБУРГ": ["78", "98", "178", "198"],
    "САМАРСКАЯ ОБЛ": ["63", "163", "763"],
    "ВОЛГОГРАДСКАЯ ОБЛ": ["34", "134"],
    "РЕСП. ТАТАРСТАН": ["16", "116", "716"],
    "ПЕНЗЕНСКАЯ ОБЛ": ["58"],
    "НИЖЕГОРОДСКАЯ ОБЛ": ["52", "152"],
    "СВЕРДЛОВСКАЯ ОБЛ": ["66", "96", "196"],
    "КРАСНОДАРСКИЙ КРАЙ": ["23", "93", "123", "193"],
    "НОВОСИБИРСКАЯ ОБЛ": ["54", "154"],
    "РОСТОВСКАЯ ОБЛ": ["61", "161", "761"],
    "УЛЬЯНОВСКАЯ ОБЛ": ["73", "173"],
}


def region_of_code() -> dict[str, str]:
    return {code: region for region, codes in REGION_CODES.items() for code in codes}


def plate_codes(spark: SparkSession) -> DataFrame:
    """code, region: a few dozen rows."""
    return spark.createDataFrame(list(region_of_code().items()), "code string, region string")
