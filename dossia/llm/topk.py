"""Exact top-k search by inner product, in three phases with a uniform threshold.

Each vector is cut into ``slices`` of its dimensions; a score is the sum of one partial score per slice.
1. Each slice's local list of highest partial scores is gathered for each query in each block of candidates; the exact
   scores of those entries give the k-th best score so far, a safe cutoff t.
2. t is sent to all blocks. An entry that matters has a partial score of at least t / slices in some slice (else its sum is below t):
   only such entries are collected.
3. Their remaining partial scores are resolved exactly, and the best k of each query stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dossia.llm.common import cut

BLOCK_ROWS = 4096
SLICES = 4
LONG = 2**63 - 1
_CHUNK = 256  # queries that a task scores at once: a matrix of 256 x 4096 numbers

_SCORES = "q_block int, query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """id, v (floor(scale * x) of each component as double, held as doubles of whole numbers), d. Unusable vectors drop out."""
    v = F.col(vec_col)
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    usable = F.coalesce(usable, F.lit(False)) & F.col(id_col).isNotNull()
    return df.where(usable).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.size(v).alias("d"))


def _blocks(vectors: DataFrame, rows: int, prefix: str) -> tuple[DataFrame, int]:
    """Blocks of about ``rows`` vectors of one dimension (ids, and a matrix as one flat array) and their number; checkpointed."""
    n = max(1, -(-vectors.count() // rows))
    packed = vectors.groupBy("d", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int").alias(f"{prefix}_block"))
    packed = packed.agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    return cut(packed.select("d", f"{prefix}_block", F.col("rows.id").alias(f"{prefix}_ids"), F.flatten("rows.v").alias(f"{prefix}_m"))), n


def _matrix(values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.asarray(values, dtype=np.float64).reshape(len(ids), -1)


def _partials(q: np.ndarray, c: np.ndarray, slices: int) -> list[np.ndarray]:
    """Partial scores per slice as int64. Products of doubles are exact while sums stay below 2**53; beyond that Python's integers are used."""
    cuts = np.array_split(np.arange(q.shape[1]), slices)
    bound = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return [(q[:, k] @ c[:, k].T).astype(np.int64) for k in cuts]
    qi, ci = ([[int(x) for x in row] for row in m] for m in (q, c))
    return [np.array([[sum(a[i] * b[i] for i in k) for b in ci] for a in qi], dtype=object).reshape(len(qi), len(ci)) for k in cuts]


def _long(x: np.ndarray) -> np.ndarray:
    """Exact whole numbers as int64; those beyond a long count as the largest or smallest one."""
    return x if x.dtype == np.int64 else np.clip(x, -LONG, LONG).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: by score downwards, then id upwards. Only those that reach the k-th best score are sorted."""
    at = np.arange(len(scores))
    if len(at) > k > 0:
        at = np.flatnonzero(scores >= np.partition(scores, len(at) - k)[len(at) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _resolved(parts: list[np.ndarray], i: int, at: np.ndarray) -> np.ndarray:
    """Exact scores of a query's entries at these positions: their partial scores of all slices are fetched and added."""
    return _long(np.sum([p[i][at] for p in parts], axis=0))


def _frame(block: int, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    ids = [np.full(len(v), q, dtype=np.int64) for q, v, _ in parts]
    query, vec, score = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ids, [p[1] for p in parts], [p[2] for p in parts]))
    return pd.DataFrame({"q_block": np.full(len(query), block, np.int32), "query_id": query, "vec_id": vec, "score": score})


def _scan(k: int, slices: int, resolve: bool):
    """Scores a block of queries against a block of candidates: phase 1, or with ``resolve`` phases 2 and 3."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                q_ids, c_ids = np.asarray(row.q_ids), np.asarray(row.c_ids)
                q_all, c = _matrix(row.q_m, q_ids), _matrix(row.c_m, c_ids)
                cutoff = dict(zip(row.cut_ids, row.cuts, strict=True)) if resolve else {}
                for start in range(0, len(q_ids), _CHUNK):
                    ids, q = q_ids[start : start + _CHUNK], q_all[start : start + _CHUNK]
                    parts = _partials(q, c, slices)
                    found = []
                    for i, qid in enumerate(ids):
                        others = np.flatnonzero(c_ids != qid)
                        if not resolve:  # each slice's local list
                            lists = [others[_best(_long(p[i][others]), c_ids[others], k)] for p in parts]
                            at = np.unique(np.concatenate(lists))
                        elif (t := cutoff.get(qid)) is not None:  # partial >= t / slices in some slice, without rounding
                            at = others[np.logical_or.reduce([(p[i][others] * slices >= t).astype(bool) for p in parts])]
                        else:  # fewer than k candidates have a score: all are collected
                            at = others
                        total = _resolved(parts, i, at)
                        best = _best(total, c_ids[at], k)
                        found.append((qid, c_ids[at][best], total[best]))
                    yield _frame(row.q_block, found)

    return scan


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    scale: int = 1024, slices: int = SLICES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores among the candidates, ties to the smaller id.

    Scores are integer inner products of floor(scale * x). A query isn't its own candidate. Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part; a score beyond a long counts as the largest or smallest long; vectors of different lengths aren't compared. Rows that repeat
    an id and its vector count once; of rows that share an id but not the vector, the largest vector is the query. Queries meet
    candidates in blocks of ``block_rows`` rows, and a task holds one block of each. Empty tables give an empty result.
    """
    cand = integer_vectors(candidates, id_col, vec_col, scale).dropDuplicates(["id", "v"])
    quer = integer_vectors(queries, id_col, vec_col, scale).groupBy("id").agg(F.max("v").alias("v")).withColumn("d", F.size("v"))
    (c_blocks, n_c), (q_blocks, n_q) = _blocks(cand, block_rows, "c"), _blocks(quer, block_rows, "q")

    def meet(q: DataFrame) -> DataFrame:
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        return c_blocks.withColumn("q_block", each(n_q)).join(q.withColumn("c_block", each(n_c)), ["d", "q_block", "c_block"])

    by_rank = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    local = meet(q_blocks).mapInPandas(_scan(k, slices, resolve=False), _SCORES)
    kth = local.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") == k)
    cuts = kth.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "score")).alias("cuts"))  # as many as a block's queries
    cuts = cut(cuts.select("q_block", F.col("cuts.query_id").alias("cut_ids"), F.col("cuts.score").alias("cuts")))
    none = F.array().cast("array<long>")
    with_cuts = q_blocks.join(cuts, "q_block", "left").withColumns({c: F.coalesce(c, none) for c in ("cut_ids", "cuts")})
    found = meet(with_cuts).mapInPandas(_scan(k, slices, resolve=True), _SCORES)
    found = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
