"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.llm.common import BROADCAST_ROWS, ascii_lower, cut, small

PREFIX_CHARS = 128


def _length(c: Column) -> Column:
    return F.octet_length(F.coalesce(c, F.lit(""))).cast("long").alias("_len")


def _head(c: Column) -> Column:
    return F.xxhash64(ascii_lower(F.substring(F.coalesce(c, F.lit("")), 1, PREFIX_CHARS))).alias("_head")


def full_hash(c: Column) -> Column:
    """SHA-256 of the text in UTF-8 with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(c, F.lit(""))), 256)


def _few(keys: DataFrame, most: int) -> bool:
    return keys.limit(most + 1).count() <= most


def shared_lengths(rows: DataFrame) -> DataFrame:
    """_len: lengths in bytes that at least two rows have; checkpointed. Rows are counted where they lie first."""
    return cut(rows.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").select("_len"))


def _headed(rows: DataFrame, few_keys: int) -> DataFrame:
    """rows with _head, the prefix hash of those that share their length. Where too many lengths are shared to be broadcast, all rows get one where they
    lie: a hash of a prefix costs less than moving texts, and lengths are compared along with it."""
    lengths = shared_lengths(rows)
    if not _few(lengths, few_keys):
        return rows.withColumn("_head", _head(F.col("_text")))
    rows = rows.join(F.broadcast(lengths.withColumn("_met", F.lit(True))), "_len", "left")
    return rows.withColumn("_head", F.when(F.col("_met"), _head(F.col("_text")))).drop("_met")


def shared_heads(headed: DataFrame) -> DataFrame:
    """(_len, _head) that at least two rows have in common; checkpointed."""
    known = headed.where(F.col("_head").isNotNull())
    return cut(known.groupBy("_len", "_head").agg(F.count("*").alias("_n")).where("_n > 1").select("_len", "_head"))


def _digested(docs: DataFrame, digest: str, few_keys: int) -> DataFrame:
    """docs (with _text) with _len, _head, _shared (whether another row has both) and _full instead of _text.

    Texts are read where they lie: joins see them only with a broadcast side, and what is shuffled is narrow.
    """
    rows = docs.withColumn("_len", _length(F.col("_text")))
    headed = _headed(rows, few_keys)
    heads = shared_heads(headed)
    shared = heads.withColumn("_shared", F.lit(True))
    full = full_hash(F.col("_text"))
    if _few(heads, few_keys):
        met = headed.join(F.broadcast(shared), ["_len", "_head"], "left")
        return met.withColumn("_full", full if digest == "all" else F.when(F.col("_shared"), full)).drop("_text")
    return headed.withColumn("_full", full).drop("_text").join(shared, ["_len", "_head"], "left")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: str = "shared", few_keys: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z. Only rows whose length and prefix hash another row shares
    get a full hash; with ``digest="all"`` the others get one too, for callers that want it as output. Where more than ``few_keys`` lengths or prefixes are shared,
    the next hash is taken of all rows instead of moving texts to find them; no text is ever shuffled. Null texts count as empty.
    The row with the largest id stays; rows without an id lose to rows with one. Of rows that repeat the same id and the same text one stays.
    If no row of a group has an id, one of them stays and keep_id is null. An empty table gives an empty result; columns of docs
    other than the two named are not read.
    """
    if digest not in ("shared", "all"):
        raise ValueError(f"digest: {digest}")
    rows = _digested(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), digest, few_keys)
    if digest == "shared":
        rows = rows.withColumn("_full", F.when(F.col("_shared"), F.col("_full")))
    alone = rows.where(F.col("_shared").isNull()).select(
        "_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"), "_full"
    )
    # Repeated rows of one id and text are interchangeable: counted here, spread out again below.
    ids = rows.where("_shared").groupBy("_full", "_len", "_id").agg(F.count("*").alias("_n"))
    groups = ids.groupBy("_full", "_len").agg(F.max("_id").alias("_keep"), F.sum("_n").alias("_size"), F.count("_id").alias("_with_id"))
    joined = ids.join(small(cut(groups)), ["_full", "_len"])
    stays = F.col("_id").eqNullSafe(F.col("_keep"))
    grouped = joined.select(
        "_id", "_keep", "_size", stays.alias("_stays"), "_full", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy")
    ).select("_id", "_keep", "_size", (F.col("_stays") & (F.col("_copy") == 1)).alias("_kept"), "_full")
    return alone.unionByName(grouped).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_full").alias("digest")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few_keys: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that stay, with their columns.

    Of rows with the same largest id and the same text any one stays; null texts count as empty, and rows without an id lose to rows with one. What stays is
    decided on narrow rows; whole rows meet the ids that go (and those repeated, of which one stays) in one join, by broadcast where these are few. Its
    key holds the id, so a large group of copies is spread. An empty table gives an empty result; other columns come along whatever their names.
    """
    text = F.col(text_col).alias("_text")
    narrow = _digested(docs.select(F.col(id_col).alias("_id"), text), "shared", few_keys).where("_shared")
    ids = cut(narrow.groupBy("_full", "_id").agg(F.count("*").alias("_n")))
    keep = cut(ids.groupBy("_full").agg(F.max("_id").alias("_keep"), F.count("*").alias("_ids"), F.max("_n").alias("_most")).where("_ids > 1 or _most > 1"))
    told = ids.join(small(keep), "_full").select("_full", "_id", (~F.col("_id").eqNullSafe(F.col("_keep"))).alias("_goes"), "_n")
    told = cut(told.where("_goes or _n > 1").select(F.col("_full").alias("_hash"), F.col("_id").alias("_of"), "_goes"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), full_hash(F.col(text_col)).alias("_full"))
    met = (F.col("_full") == F.col("_hash")) & F.col("_id").eqNullSafe(F.col("_of"))
    stays = whole.join(small(told, few_keys), met, "left").where("_goes is null or not _goes")
    once = stays.where("_goes is not null").dropDuplicates(["_full", "_id"])
    return stays.where("_goes is null").select("_row.*").unionByName(once.select("_row.*"))
