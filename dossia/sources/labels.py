"""Labelled documents, extraction records and stored cards: readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from dossia.schema import CHECK, DOC_FIELDS, ITEM, RECORD


#: Folders of lines that were appended; the name sorts behind those of Spark's files.
APPENDED = "then-"


class StrictSchema(ValueError):
    """Lines that don't hold exactly the schema's keys."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, seq of the lines of text files that aren't blank. seq (file, start, row) is the line's place: its file, where its split starts there, and its turn in the split; it orders
    lines as the files and appends do, however these are split among tasks."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    seq = F.struct("file", "start", F.monotonically_increasing_id().alias("row"))
    return rows.select("line", seq.alias("seq")).where(F.trim("line") != "")


def audit_items(spark: SparkSession, path: str, schema: str = ITEM) -> DataFrame:
    """seq, problem, key of each departure of a line from the schema: ``json`` (no object), ``unknown``, ``missing`` and ``repeated`` keys."""
    lines = read_lines(spark, path)
    keys = F.json_object_keys("line")
    want = F.array(*[F.lit(f.name) for f in T.StructType.fromDDL(schema).fields])
    found = F.transform(F.array_except(keys, want), lambda k: F.struct(F.lit("unknown").alias("problem"), k.alias("key")))
    gone = F.transform(F.array_except(want, keys), lambda k: F.struct(F.lit("missing").alias("problem"), k.alias("key")))
    twice = F.array_distinct(F.filter(keys, lambda k: F.size(F.filter(keys, lambda o: o == k)) > 1))
    twice = F.transform(twice, lambda k: F.struct(F.lit("repeated").alias("problem"), k.alias("key")))
    none = F.array(F.struct(F.lit("json").alias("problem"), F.lit(None).cast("string").alias("key")))
    return lines.select("seq", F.inline(F.when(keys.isNull(), none).otherwise(F.concat(found, gone, twice))))


def read_items(spark: SparkSession, path: str, split: str | None = None, strict: bool = False) -> DataFrame:
    """Labelled documents as JSON lines; broken lines are errors. ``split``: one of them, else all.

    Unknown keys are passed over and missing ones null; with ``strict`` either is an error (see ``audit_items``), raised before anything is read.
    """
    if strict and (wrong := audit_items(spark, path).limit(5).collect()):
        raise StrictSchema("; ".join(f"{r.seq.file} from {r.seq.start}, row {r.seq.row}: {r.problem} {r.key or ''}".strip() for r in wrong))
    items = spark.read.schema(ITEM).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)
    return items if split in (None, "all") else items.where(F.col("split") == split)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Extraction records as JSON lines with ``seq``, their place in the files; none where the path doesn't exist. Blank lines don't count."""
    try:
        lines = read_lines(spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], f"{RECORD}, seq struct<file:string,start:long,row:long>")
        raise
    return lines.select(F.from_json("line", RECORD).alias("r"), "seq").select("r.*", "seq")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line, letters unescaped. Appending is how a run goes on where it stopped.

    Each append has a folder of its own, numbered, whose name comes after what is there: so the lines' places (see ``read_lines``) follow the order of
    appends, which the random names of Spark's files wouldn't. Two appends at once can't share a number: one of them fails and writes nothing.
    """
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if append and fs.exists(where):
        numbers = [int(f.getPath().getName().removeprefix(APPENDED)) for f in fs.listStatus(where) if f.getPath().getName().startswith(APPENDED)]
        path = f"{path}/{APPENDED}{max(numbers, default=0) + 1:09d}"
    df.write.mode("errorifexists").json(path)


def decode_documents(store: DataFrame) -> DataFrame:
    """Stored documents with their JSON columns as a map and an array of findings."""
    return store.withColumns({"fields": F.from_json("fields", "map<string,string>"), "checks": F.from_json("checks", CHECK)})


def long_fields(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """id, key, value: one row for each field of each document; documents without fields have none."""
    return docs.select(id_col, F.explode("fields").alias("key", "value"))


def in_one_line(*columns: str) -> Column:
    """Values of some columns parted by spaces; null and empty ones are left out."""
    return F.concat_ws(" ", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns])


def as_json(columns: list[str]) -> Column:
    """A row's columns as one JSON object; null ones are left out, letters stay as they are."""
    return F.to_json(F.struct(*columns))


def encode_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"fields": F.to_json("fields"), "checks": F.to_json("checks")})


def truncate(spark: SparkSession, schema: str, path: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path and content of image files; nothing is decoded."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def data_url(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def variant_path(image: Column, photo: Column, variant: Column) -> Column:
    """The file that a variant starts from: the photo for ``photo``, the scan for ``clean`` and distortions."""
    return F.when(variant == "photo", photo).otherwise(image)


def categories(spark: SparkSession) -> DataFrame:
    keys = sorted({k for ks in DOC_FIELDS.values() for k in ks})
    return spark.createDataFrame(list(enumerate(keys, 1)), "id int, name string")


def global_ids(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows numbered from 1 in order, by range: each range is numbered apart and shifted by the sizes of those before it."""
    ranged = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(order)))
    from dossia.operators.checkpoints import cut

    ranged = cut(ranged)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))  # one row for each range
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")


def annotations(items: DataFrame, spark: SparkSession, images: DataFrame | None = None) -> DataFrame:
    """id (a running number by item and box), item, image_id, category_id, bbox (x, y, w, h), area, iscrowd, attributes (value) and value of each box.

    ``images``: id and number of the items' images (see ``image_table``); without it image_id is null.
    """
    box = F.col("box")
    rows = items.select(F.col("id").alias("item"), "fields", F.posexplode(F.array_sort(F.map_entries("boxes"))).alias("pos", "e"))
    rows = rows.select("item", "pos", F.col("e.key").alias("name"), F.col("e.value").alias("box"), "fields")
    size = [box[2] - box[0], box[3] - box[1]]
    value = F.coalesce(F.element_at("fields", F.col("name")), F.lit(""))
    rows = rows.join(F.broadcast(categories(spark).select(F.col("id").alias("category_id"), "name")), "name").select(
        F.concat_ws("/", "item", F.lpad(F.col("pos").cast("string"), 6, "0")).alias("_order"), "item", "category_id",
        F.array(box[0], box[1], *size).alias("bbox"), (size[0] * size[1]).alias("area"), F.lit(0).alias("iscrowd"), F.struct(value.alias("value")).alias("attributes"), value.alias("value"),
    )
    if images is None:
        rows = rows.withColumn("image_id", F.lit(None).cast("long"))
    else:
        rows = rows.join(images.select(F.col("item"), F.col("id").alias("image_id")), "item")
    return global_ids(rows, "_order", "id").drop("_order")


def image_table(items: DataFrame) -> DataFrame:
    """id (a running number from 1, by item), item, file_name, width, height, doc_type, split of each item's image."""
    rows = items.select(F.col("id").alias("item"), F.col("image").alias("file_name"), "width", "height", "doc_type", "split")
    return global_ids(rows, "item", "id")


def write_coco(items: DataFrame, path: str, description: str = "labelled documents", version: str = "1.0") -> None:
    """info, images, annotations and categories as four folders of JSON lines: the data set needn't fit in one file."""
    from dossia.operators.checkpoints import cut

    spark = items.sparkSession
    images = cut(image_table(items))
    spark.createDataFrame([(description, version)], "description string, version string").coalesce(1).write.json(f"{path}/info")
    images.drop("item").write.json(f"{path}/images")
    annotations(items, spark, images).drop("item", "value").write.json(f"{path}/annotations")
    categories(spark).withColumn("supercategory", F.lit("field")).write.json(f"{path}/categories")


def coco_json(path: str, spark: SparkSession) -> str:
    """One JSON object of what write_coco wrote, for data sets that fit in the driver."""
    import json

    part = lambda name: [json.loads(r.value) for r in spark.read.text(f"{path}/{name}").collect()]
    by_id = lambda name: sorted(part(name), key=lambda r: r["id"])
    return json.dumps({"info": part("info")[0]} | {n: by_id(n) for n in ("images", "annotations", "categories")}, ensure_ascii=False)


def extract_with(docs: DataFrame, engine: Callable[[], Callable[[bytes], str]], content: str = "content") -> DataFrame:
    """id, answer, seconds, error: an engine's answer to each document. ``engine`` is called once for each partition (a session, a model)."""
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = engine()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                began, answer, error = time.time(), None, None
                try:
                    answer = ask(getattr(row, content))
                except Exception as e:  # a failed document is a row, not a failed job
                    error = f"{type(e).__name__}: {e}"
                out.append((row.id, answer, round(time.time() - began, 3), error))
            yield pd.DataFrame(out, columns=["id", "answer", "seconds", "error"])

    return docs.select(F.col("id").cast("string").alias("id"), content).mapInPandas(run, "id string, answer string, seconds double, error string")
