"""Filling a store: where its documents come from, and a mark of the data set that is written once."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.operators.checkpoints import cut
from dossia.operators.linking import card_values
from dossia.operators.metrics import DataMismatch
from dossia.sources.generate import documents, vehicles
from dossia.sources.labels import global_ids
from dossia.sources.store import add_batch

#: Labels of fewer vehicles than this are too few to search in: documents are generated instead, of so many vehicles.
LEAST_VEHICLES = 100
GENERATED_VEHICLES = 300


def result_type(predicted: Column, labelled: Column) -> Column:
    """The type by which a result is stored: the predicted one, where it is missing or empty the label's."""
    return F.coalesce(F.nullif(predicted, F.lit("")), labelled)


def documents_of_results(records: DataFrame, items: DataFrame, variant: str, engine: str = "") -> DataFrame:
    """id, doc_type, fields, source, engine, place of the records of one variant, by their place in the files. Records of unknown documents keep their own type and
    have none where that is missing."""
    place = F.col("seq") if "seq" in records.columns else F.monotonically_increasing_id()
    rows = records.where(F.col("variant") == variant).select("id", "pred_doc_type", "fields", place.alias("place"))
    known = items.select("id", F.col("doc_type").alias("labelled"))
    rows = rows.join(known, "id", "left").withColumn("doc_type", result_type(F.col("pred_doc_type"), F.col("labelled")))
    return rows.select("id", "doc_type", "fields", F.col("id").alias("source"), F.lit(engine).alias("engine"), "place")


def choose_documents(
    spark: SparkSession, items: DataFrame | None = None, records: DataFrame | None = None, variant: str = "clean", engine: str = "", least: int = LEAST_VEHICLES, seed: int = 42,
) -> DataFrame:
    """Documents to fill a store with: the results of a variant where there are records, else labels of at least ``least`` vehicles, else generated ones."""
    if records is not None:
        if items is None:
            raise ValueError("results need the labels that they belong to")
        return documents_of_results(records, items, variant, engine)
    if items is None or items.select("vehicle_id").distinct().limit(least).count() < least:
        items = documents(vehicles(spark, GENERATED_VEHICLES, seed))
    return items.select("id", "doc_type", "fields", F.col("id").alias("source"), F.lit("labels").alias("engine"), F.col("id").alias("place"))


def fill_store(spark: SparkSession, path: str, docs: DataFrame) -> int:
    """Adds documents (doc_type, fields, place) to the store at ``path`` in order of place; their number."""
    numbered = cut(global_ids(docs.select("place", "doc_type", "fields"), "place", "seq"))
    add_batch(spark, path, numbered.select(F.col("seq").cast("long").alias("seq"), *card_values(F.col("doc_type"), F.col("fields"))))
    return numbered.count()


def stamp(spark: SparkSession, path: str, fingerprint: str) -> str:
    """Marks results at ``path`` as those of a data set; the mark that holds afterwards.

    The file is made only where there is none, by one atomic create: of several that try at once one writes and the others read what it wrote. Raises DataMismatch if that is
    another data set's.
    """
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(file, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
    else:
        out.write(bytearray(json.dumps({"data_fingerprint": fingerprint}).encode()))
        out.close()
    held = json.loads(spark.read.text(path, wholetext=True).first().value)["data_fingerprint"]
    if held != fingerprint:
        raise DataMismatch(f"results belong to {held}, the data is {fingerprint}")
    return held
