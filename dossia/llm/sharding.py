"""Shards of a table in random order: a two-pass external shuffle.

Pass 1 scatters records uniformly into memory-sized buckets by a seeded hash; pass 2 shuffles each bucket (Spark's
``shuffle`` is a Fisher-Yates shuffle) and lays the buckets one after another. Records are dealt to shards from that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from dossia.llm.common import cut, small

RECORD_OVERHEAD = 16
#: Bytes of strings that one bucket holds in memory.
BUCKET_BYTES = 16 << 20


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed overhead for each record."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_OVERHEAD).cast("long")


def _row_bytes(columns: list[tuple[str, str]]) -> Column:
    """Bytes of a row: those of its strings and binaries, and a fixed overhead."""
    size = F.lit(RECORD_OVERHEAD).cast("long")
    for name, kind in columns:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f"_row.`{name}`"), F.lit(0))
    return size


def _scattered(rows: DataFrame, seed: int, bucket_rows: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """_row and _bucket for each row, and the number of buckets. Only rows that are repeated are grouped; others pass without a shuffle."""
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))
    total, size = whole.agg(F.count("*"), F.coalesce(F.sum(_row_bytes(rows.dtypes)), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_rows), -(-size // bucket_bytes))
    hashed = whole.withColumn("_hash", F.xxhash64("_row"))
    repeated = small(cut(hashed.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")))
    again = hashed.join(repeated, "_hash", "left_semi").groupBy("_row").agg(F.count("*").alias("_n"))
    again = again.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy"))
    once = hashed.join(repeated, "_hash", "left_anti").select("_row", F.lit(1).cast("long").alias("_copy"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "_row", "_copy"), F.lit(buckets)).alias("_bucket")
    return once.unionByName(again).select("_row", bucket), buckets


def shuffled_order(rows: DataFrame, seed: int = 17, bucket_rows: int = 20_000, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """rows with position: a random permutation, from 0 without gaps, and bucket.

    Equal rows are counted before they are dealt out, and each copy's number enters the seeded hash, so that a row
    repeated many times fills no bucket; buckets hold about ``bucket_rows`` rows or ``bucket_bytes`` bytes of strings, whichever is
    less, as one task holds a whole bucket. Bucket offsets are sums over one row per bucket.
    The order within a bucket is drawn by the task that lays it out, from a stream that the seed and the partition's number fix: a task that runs
    again gives each record the same position. Columns of a map type have no order and are refused.
    """
    scattered, buckets = _scattered(rows, seed, bucket_rows, bucket_bytes)
    sizes = cut(scattered.groupBy("_bucket").agg(F.count("*").alias("_size")))
    # Buckets are summed in groups of a fixed size, then the groups: no window over all buckets.
    group = F.floor(F.col("_bucket") / 4096)
    groups = sizes.groupBy(group.alias("_group")).agg(F.sum("_size").alias("_sum"))
    groups = groups.select("_group", (F.sum("_sum").over(W.orderBy("_group")) - F.col("_sum")).alias("_base"))
    within = F.sum("_size").over(W.partitionBy("_group").orderBy("_bucket")) - F.col("_size")
    offsets = sizes.withColumn("_group", group).withColumn("_within", within).join(groups, "_group").select("_bucket", (F.col("_base") + F.col("_within")).alias("_offset"))
    # As many tasks as buckets, so that none gathers many of them.
    dealt = scattered.repartition(buckets, "_bucket")
    held = dealt.groupBy("_bucket").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    # Spark draws for one row after another of a partition: in a fixed order of buckets, a task that runs again draws the same.
    laid = held.sortWithinPartitions("_bucket").select("_bucket", F.shuffle("_rows", seed).alias("_rows")).join(small(cut(offsets)), "_bucket")
    return laid.select("_bucket", "_offset", F.posexplode("_rows").alias("_at", "_row")).select(
        "_row.*", (F.col("_offset") + F.col("_at")).alias("position"), F.col("_bucket").alias("bucket")
    )


def shard_rows(rows: DataFrame, shards: int, seed: int = 17, bucket_rows: int = 20_000) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (from 0 without gaps): law ``rows``, counts at most one apart.

    The shuffled order is dealt out in turn, so any shard is a uniform sample and any slot order a random one. Nulls and
    repeated rows are rows like others; an empty table gives an empty result.
    """
    placed = shuffled_order(rows, seed, bucket_rows)
    return placed.withColumns(
        {"shard": F.pmod("position", F.lit(shards)).cast("int"), "slot": F.floor(F.col("position") / shards).cast("long")}
    ).drop("position", "bucket")


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 17, bucket_rows: int = 20_000) -> None:
    """Writes whole rows as Parquet, one folder per shard, in slot order within each file; a file holds runs of ``bucket_rows`` slots.

    Nulls, empty and repeated rows are rows like others, and a row of any length is written whole; columns named shard or slot are replaced; an empty table gives
    a folder without shards. Positions don't depend on which task draws them, so lost executors neither drop nor repeat rows.
    """
    placed = shard_rows(docs, shards, seed, bucket_rows)
    run = F.floor(F.col("slot") / bucket_rows)
    placed.repartition("shard", run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What write_shards wrote of rows of this schema, with shard and slot."""
    kept = T.StructType([f for f in schema.fields if f.name not in ("shard", "slot")])
    return spark.read.schema(kept.add("slot", T.LongType()).add("shard", T.IntegerType())).parquet(path)
