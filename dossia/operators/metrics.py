"""Scores of extraction results against labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dossia.functions.canon import base, canon_of_base, cer
from dossia.operators import joins
from dossia.operators.checkpoints import cut


def scored_fields(records: DataFrame, truth: DataFrame) -> DataFrame:
    """variant, id, doc_type, pred_doc_type, seconds, error, key, ok, cer: one row for each labelled field of each record.

    Records without a labelled document drop out; fields that the record lacks count as empty, further ones are ignored. A document
    without fields gives one row without a key. Each of a document's records counts; ``rec`` tells them apart and orders them: by the place
    in their file where the records say it (``seq``, see ``labels.read_records``), else by the order in which they are read.
    """
    place = F.col("seq") if "seq" in records.columns else F.monotonically_increasing_id()
    t = truth.select("id", F.col("doc_type").alias("doc_type"), F.col("fields").alias("true_fields"))
    r = records.select("id", "variant", "pred_doc_type", "seconds", "error", F.col("fields").alias("pred_fields"), place.alias("rec"))
    long = r.join(t, "id").select("*", F.explode_outer("true_fields").alias("key", "true"))
    # Base forms of both values first, then the field's rule, for both by one lambda.
    pair = F.array(base(F.element_at("pred_fields", F.col("key"))), base(F.col("true")))
    both = F.transform(pair, lambda s: canon_of_base(F.col("key"), s))
    long = long.withColumn("both", F.when(F.col("key").isNotNull(), both)).withColumns({"p": F.col("both")[0], "t": F.col("both")[1]})
    return long.select("variant", "rec", "id", "doc_type", "pred_doc_type", "seconds", "error", "key", (F.col("p") == F.col("t")).alias("ok"), F.when(F.col("key").isNotNull(), cer(F.col("p"), F.col("t"))).alias("cer"))


#: Ranges into which the values of a group are counted at once, and values of a group that are sorted in the end.
RANGES = 256
SORTED_ROWS = 4096


def exact_median(rows: DataFrame, group: str, value: str, ranges: int = RANGES, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """group, median of each group's values (the mean of the middle two where they are even in number); nulls and NaN don't count, a null group is one.

    Selection instead of sorting: values are counted in equal ranges of what is left of a group, and only the range that holds a middle one goes on, until few
    values are left or all are equal. Each pass sends ``ranges`` counts for a group and task at most; values are sent only where the groups are too many to be broadcast. A group without values has no row.
    """
    one = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    sizes = one.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("k")
    # Of each group one or two places, counted from 0: within [low, high] the value number k is sought.
    left = cut(sizes.select(F.col("g").alias("of"), "low", "high", "n", middle).withColumn("place", F.col("k")))
    within = F.expr("g <=> of and x between low and high")
    more = F.expr(f"low < high and n > {sorted_rows}")
    while not left.where(more).isEmpty():
        share = F.expr("(x / 2 - low / 2) / (high / 2 - low / 2)")  # halves don't overflow
        met = joins.met(one, left.where(more), within).withColumn("range", F.least(F.floor(share * ranges), F.lit(ranges - 1)).cast("int"))
        counts = met.groupBy("of", "place", "range").agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"), F.first("k").alias("k"))
        before = (F.sum("c").over(W.partitionBy("of", "place").orderBy("range")) - F.col("c")).alias("b")
        chosen = counts.select("*", before).where("b <= k and k < b + c").select("of", "low", "high", F.col("c").alias("n"), (F.col("k") - F.col("b")).alias("k"), "place")
        left = cut(left.where(~more).unionByName(chosen))
    met = joins.met(one, left.where("low < high"), within)
    turn = F.row_number().over(W.partitionBy("of", "place").orderBy("x")) - 1
    found = met.withColumn("r", turn).where("r = k").select(F.col("of").alias("g"), "x")
    found = found.unionByName(left.where("low >= high").select(F.col("of").alias("g"), F.col("low").alias("x")))
    return found.groupBy("g").agg(F.avg("x").alias("median")).withColumnRenamed("g", group)


def score(fields: DataFrame) -> DataFrame:
    """variant, documents, fields, field_accuracy, document_accuracy, doc_type_accuracy, mean_cer, median_seconds, errors.

    One aggregation per record (its fields come from one map, so this is small), then one per variant. The median is found by counting ranges
    of values, so no task holds a variant's values.
    """
    per = fields.groupBy("variant", "rec").agg(
        F.count("key").alias("n"),
        F.count_if("ok").alias("right"),
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_ok"),
        F.sum("cer").alias("cer"),
        F.first("pred_doc_type").eqNullSafe(F.first("doc_type")).alias("type_ok"),
        F.coalesce(F.first("seconds"), F.lit(0.0)).alias("seconds"),
        (F.coalesce(F.first("error"), F.lit("")) != "").alias("failed"),
    )
    per = cut(per.drop("rec"))
    share = lambda c: F.avg(F.col(c).cast("int"))
    sums = per.groupBy("variant").agg(
        F.count("*").alias("documents"),
        F.sum("n").alias("fields"),
        F.try_divide(F.sum("right"), F.sum("n")).alias("field_accuracy"),
        share("all_ok").alias("document_accuracy"),
        share("type_ok").alias("doc_type_accuracy"),
        F.try_divide(F.sum("cer"), F.sum("n")).alias("mean_cer"),
        F.count_if("failed").alias("errors"),
    )
    medians = exact_median(per, "variant", "seconds").select(F.col("variant").alias("_variant"), F.col("median").alias("median_seconds"))
    columns = ["variant", "documents", "fields", "field_accuracy", "document_accuracy", "doc_type_accuracy", "mean_cer", "median_seconds", "errors"]
    return sums.join(medians, F.col("variant").eqNullSafe(F.col("_variant")), "left").select(*columns)


def accuracy_cube(fields: DataFrame) -> DataFrame:
    """variant, key, doc_type, accuracy: per variant, per field and per true document type in one pass."""
    rows = fields.where("key is not null").select("variant", "key", "doc_type", F.col("ok").cast("int").alias("ok"))
    sets = [[F.col("variant")], [F.col("variant"), F.col("key")], [F.col("variant"), F.col("doc_type")]]
    return rows.groupingSets(sets, "variant", "key", "doc_type").agg(F.avg("ok").alias("accuracy"), F.count("*").alias("n"))


def latest(records: DataFrame, order: str, keys: tuple[str, ...] = ("variant", "id")) -> DataFrame:
    """The last record of each key."""
    last = W.partitionBy(*keys).orderBy(F.desc(order))
    return records.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def robustness(fields: DataFrame) -> DataFrame:
    """kind, level, accuracy: variants named kind:level, and level 0 from the clean variant of the same documents.

    Of a document's repeated records under one variant only the last one counts, by the order in which they were read.
    """
    last = F.max("rec").over(W.partitionBy("variant", "id"))
    rows = fields.withColumn("_last", last).where("rec = _last and key is not null").select("variant", "id", F.col("ok").cast("int").alias("ok"))
    stress = rows.where(F.col("variant").contains(":")).select(
        F.split_part("variant", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("variant", F.lit(":"), F.lit(2)).cast("int").alias("level"), "id", "ok"
    )
    seen = stress.select("kind", "id").distinct()
    base = rows.where("variant = 'clean'").join(seen, "id").select("kind", F.lit(0).alias("level"), "id", "ok")
    return stress.unionByName(base).groupBy("kind", "level").agg(F.avg("ok").alias("accuracy"))


#: Names of variants that a work list is made for.
MOST_VARIANTS = 10_000


def worklist(items: DataFrame, variants: DataFrame, done: DataFrame) -> DataFrame:
    """id, variant pairs that have no record yet; ``variants`` holds at most MOST_VARIANTS names."""
    names = [r.variant for r in variants.select("variant").distinct().limit(MOST_VARIANTS + 1).collect()]
    if len(names) > MOST_VARIANTS:
        raise ValueError(f"more than {MOST_VARIANTS} variants")
    todo = items.select("id", F.explode(F.array(*map(F.lit, names))).alias("variant")) if names else items.select("id", F.lit("").alias("variant")).limit(0)
    return todo.join(done.select("id", "variant").distinct(), ["id", "variant"], "left_anti")


def first_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def ids_of_all(rows: DataFrame, id_col: str, engine: str) -> DataFrame:
    """Ids that every engine with rows has."""
    engines = rows.select(engine).distinct().count()
    return rows.groupBy(id_col).agg(F.countDistinct(engine).alias("n")).where(F.col("n") == engines).select(id_col)


#: Rows that a leaf of the hash tree holds on average; each level above combines up to 4096 nodes.
LEAF_ROWS = 4096


def fingerprint(items: DataFrame, key: str, *columns: Column, levels: int | None = None) -> DataFrame:
    """fingerprint: 12 hex digits that change with any row.

    A null counts as other than any text, in its own place. Each row is hashed where it lies; hashes are combined in a tree: leaves are buckets of the key's
    hash, in order of key, and each node stands for up to 4096 below it. Its depth grows with the number of rows (one level up to
    16 million), so that no task holds more than a bucket or a node's children; the value depends on the rows alone, not on where they lie.
    """
    row = F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0002")) for c in (F.col(key), *columns)]), 256)
    hashed = items.select(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("\u0002")), 256).alias("b"), F.col(key).cast("string").alias("k"), row.alias("h"))
    if levels is None:
        rows, levels = items.count(), 1
        while rows > LEAF_ROWS * 4096**levels:
            levels += 1
    nodes = _combined(hashed.withColumn("b", F.substring("b", 1, 3 * levels)), F.struct("k", "h"))
    for level in range(levels - 1, -1, -1):
        nodes = _combined(nodes.select(F.substring("b", 1, 3 * level).alias("b"), F.col("b").alias("k"), "h"), F.struct("k", "h"))
    empty = F.sha2(F.lit(""), 256)
    return nodes.agg(F.substring(F.coalesce(F.max("h"), empty), 1, 12).alias("fingerprint"))


def _combined(rows: DataFrame, member: Column) -> DataFrame:
    """b, h: for each bucket the hash of its members' hashes in order."""
    members = F.array_sort(F.collect_list(member))
    return rows.groupBy("b").agg(F.sha2(F.array_join(F.transform(members, lambda r: r["h"]), ""), 256).alias("h"))


class DataMismatch(ValueError):
    """Results belong to other data."""


def check_fingerprint(stored: DataFrame | None, now: DataFrame) -> str:
    """The data's fingerprint; raises DataMismatch if the stored one differs."""
    value = now.first().fingerprint
    if stored is not None and (row := stored.first()) is not None and row.fingerprint != value:
        raise DataMismatch(f"results belong to {row.fingerprint}, the data is {value}")
    return value


def summary(scores: DataFrame, cube: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """variant, summary: the scores of each variant as one JSON object, with its shares by field and by type; with ``curves`` a row without a variant holds the robustness."""
    by = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(c, "accuracy"))))).alias(f"per_{c}")
    rows = scores.join(cube.groupBy("variant").agg(by("key"), by("doc_type")), "variant", "left")
    rows = rows.select("variant", F.to_json(F.struct(*[c for c in rows.columns if c != "variant"])).alias("summary"))
    if curves is None:
        return rows
    level = F.array_sort(F.collect_list(F.struct("kind", "level", "accuracy")))
    return rows.unionByName(curves.agg(F.to_json(F.struct(level.alias("robustness"))).alias("summary")).select(F.lit(None).cast("string").alias("variant"), "summary"))


def engine_label(engine: Column) -> Column:
    """An engine's name for readers: the model's name and size where it is known, else what follows ``vlm_``."""
    model = F.when(F.contains(engine, F.lit("_")), F.regexp_extract(engine, "^[^_]*_(.*)$", 1)).otherwise(engine)
    known = r"(?i)qwen(\d(?:\.\d)?)[-_]?vl[-_:]?(\d+b)?"
    number, size = F.regexp_extract(model, known, 1), F.upper(F.regexp_extract(model, known, 2))
    named = F.concat(F.lit("Qwen"), number, F.lit("-VL"), F.when(size != "", F.concat(F.lit(" "), size)).otherwise(""))
    vlm = F.when(number != "", named).otherwise(model)
    return F.when(engine.startswith("vlm"), vlm).when(engine == "tesseract", "Tesseract 5 + правила").otherwise(engine)


def engine_order(engine: Column) -> list[Column]:
    """Model engines first, then by name."""
    return [(~engine.startswith("vlm")).asc(), engine.asc()]


#: Engines that one chart shows.
MOST_ENGINES = 1000


def field_chart(accuracies: DataFrame, engine: str = "engine", key: str = "key", value: str = "accuracy") -> DataFrame:
    """key, engine, accuracy (0 where an engine lacks the field), best: rows of a chart by field, best fields first by their best engine."""
    names = [r[0] for r in accuracies.select(engine).distinct().orderBy(engine).limit(MOST_ENGINES + 1).collect()]
    if len(names) > MOST_ENGINES:
        raise ValueError(f"more than {MOST_ENGINES} engines")
    best = accuracies.groupBy(key).agg(F.coalesce(F.max(value), F.lit(0.0)).alias("best"), F.collect_set(F.struct(engine, value)).alias("held"))
    rows = best.select(key, "best", "held", F.explode(F.array(*map(F.lit, names))).alias(engine)) if names else best.withColumn(engine, F.lit("")).limit(0)
    mine = F.filter("held", lambda h: h[engine] == F.col(engine))
    return rows.select(key, engine, F.coalesce(F.get(mine, 0)[value], F.lit(0.0)).alias(value), "best").orderBy(F.desc("best"), key, *engine_order(F.col(engine)))


def dataset_counts(items: DataFrame) -> DataFrame:
    """vehicles, documents, boxes, test: distinct vehicles, rows, boxes in all, rows of the test part."""
    return items.agg(
        F.countDistinct("vehicle_id").alias("vehicles"), F.count("*").alias("documents"), F.coalesce(F.sum(F.coalesce(F.size("boxes"), F.lit(0))), F.lit(0)).alias("boxes"),
        F.count_if(F.col("split") == "test").alias("test"),
    )


def report(scores: DataFrame, titles: dict[str, str]) -> str:
    """A Markdown table of engine, variant and scores: variants in the order of ``titles``, model engines first. scores: those of ``score`` with a column engine (a few rows)."""
    from dossia.functions.canon import percent_text

    order = F.element_at(F.create_map(*[F.lit(x) for n, v in enumerate(titles) for x in (v, n)]), F.col("variant"))
    shares = ["field_accuracy", "document_accuracy", "doc_type_accuracy"]
    rows = scores.where(F.col("variant").isin(list(titles))).select(
        engine_label(F.col("engine")).alias("label"), "variant", "documents", *[percent_text(F.col(c)).alias(c) for c in shares],
        F.format_number("mean_cer", 3).alias("cer"), F.format_number("median_seconds", 1).alias("seconds"), "engine", order.alias("n"),
    )
    head = ["Движок", "Вариант", "Документов", "Верных полей", "Документов без ошибок", "Вид определён", "CER", "Секунд"]
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for r in rows.orderBy(*engine_order(F.col("engine")), "n").limit(len(titles) * MOST_ENGINES).collect():
        lines.append("| " + " | ".join(str(x) for x in (r.label, titles[r.variant], r.documents, *[r[c] for c in shares], r.cer, r.seconds)) + " |")
    return "\n".join(lines)


def between_marks(text: str, block: str, start: str, end: str) -> str | None:
    """text with what stands between two marks replaced by block; None if a mark is missing."""
    if start not in text or end not in text[text.index(start) :]:
        return None
    head, rest = text.split(start, 1)
    return head + start + "\n" + block + "\n" + end + rest.split(end, 1)[1]


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table, by name."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    whole = rows[0]
    for one in rows[1:]:
        whole = whole.unionByName(one)
    return whole.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])
