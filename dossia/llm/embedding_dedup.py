"""Near-duplicate vectors: spherical k-means assigns vectors to cells, blocked cosine products compare within cells, one vector of each group stays.

No link is lost at the cells' borders. A vector whose nearest centre is h can be within the chord s of a vector whose nearest centre is c only if
x.(h - c) <= s |h - c|; it visits such cells of a higher number, so each pair meets in exactly one cell. Vectors so near to a
cell's centre that any two of them must be linked (its core) are counted, not compared; so a large group of close copies costs no products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossia.llm.common import BROADCAST_ROWS, cut, drawn, small
from dossia.operators.components import components

THRESHOLD = 0.98
#: One cell for so many distinct vectors, up to MOST_CELLS (or CENTRE_BYTES of centres); beyond that cells grow and are compared block by block.
CELL_ROWS = 4096
MOST_CELLS = 256
CENTRE_BYTES = 16 << 20
#: The centres are fitted on about so many vectors for each cell, in so many rounds.
SAMPLE_ROWS = 64
ROUNDS = 5
#: Centres as near as this to another one are left out, so that a dense group isn't cut up among many.
APART = 0.9
BLOCK_ROWS = 2048
BLOCK_BYTES = 4 << 20
#: Bounds are widened by this, far above rounding, far below what matters.
SLACK = 1e-9

CORE, HOME, VISITOR = 0, 1, 2


def unit_vectors(rows: DataFrame, vec_col: str, out_col: str) -> DataFrame:
    """rows with ``out_col`` instead of ``vec_col``: the vector divided by its length in double precision; null if it is null, empty, zero or holds a
    null or non-finite component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vec_col)
            size = np.asarray(pc.list_value_length(column).fill_null(0))
            out = np.empty(len(size), dtype=object)
            for d in np.unique(size[size > 0]).tolist():  # vectors of one length at a time
                at = np.flatnonzero(size == d)
                v = np.asarray(column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64).reshape(-1, d)
                most = np.abs(v).max(axis=1, keepdims=True)
                good = np.flatnonzero(np.isfinite(most[:, 0]) & (most[:, 0] > 0))
                v = v[good] / most[good]  # so that no square overflows or vanishes
                v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
                for k, x in zip(at[good].tolist(), v, strict=True):
                    out[k] = x
            rest = [c for c in batch.schema.names if c != vec_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, pa.list_(pa.float64()))], names=[*rest, out_col])

    fields = [f for f in rows.schema.fields if f.name != vec_col]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))]))


def _matrix(column: pd.Series | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        flat = np.concatenate([np.asarray(c.flatten(), dtype=np.float64) for c in column.chunks] or [np.zeros(0)])
    else:
        flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(-1, d)


def _apart(centres: np.ndarray) -> np.ndarray:
    """The centres, in order, that aren't near to one kept before."""
    kept: list[int] = []
    for k, c in enumerate(centres):
        if not kept or (centres[kept] @ c).max() < APART:
            kept.append(k)
    return centres[kept]


def centres_of(vectors: DataFrame, d: int, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centres of at most ``cells`` cells, by spherical k-means over the unit vectors (column v, all of d components) of a bounded sample.

    The sample is drawn by a 64-bit hash, about SAMPLE_ROWS vectors for each cell. Each round sends sums for each centre to the driver.
    """
    rows = vectors.count()
    sample = cut(vectors.where(drawn(F.xxhash64(F.lit(seed), "v"), SAMPLE_ROWS * cells, rows)).select("v"))
    first = sample.orderBy(F.xxhash64(F.lit(seed + 1), "v")).limit(4 * cells).collect()  # four vectors for each cell at most
    if cells <= 1 or not first:
        return np.zeros((0, d))
    centres = _apart(np.array([r.v for r in first]))[:cells]
    for _ in range(rounds):
        sent = sample.sparkSession.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(sent.value)
            for batch in batches:
                v = _matrix(batch.column(0), d)
                np.add.at(total, (v @ sent.value.T).argmax(axis=1), v)
            cell, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[cell, at])], names=["cell", "at", "s"])

        got = sample.mapInArrow(sums, "cell int, at int, s double").groupBy("cell", "at").agg(F.sum("s").alias("s")).toPandas()  # cells x d numbers
        total = np.zeros_like(centres)
        total[got["cell"], got["at"]] = got["s"]
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = _apart(np.where(length > 1e-12, total / np.maximum(length, 1e-12), centres))
    return centres


def _assign(d: int, centres: np.ndarray, threshold: float):
    """Each vector at home in its nearest cell, in its core or not, and as a visitor of cells across whose border it could have a link."""
    chord, core = np.sqrt(2 - 2 * threshold) + SLACK, np.sqrt((1 + threshold) / 2) + SLACK

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = np.linalg.norm(centres[:, None] - centres[None], axis=2) if len(centres) < 2000 else None
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                dims = np.asarray(batch.column("d"))
                n = len(dims)
                row, cell, kind = [np.arange(n)], [np.zeros(n, np.int32)], [np.full(n, HOME, np.int8)]
                at = np.flatnonzero(dims == d) if len(centres) else np.zeros(0, np.int64)
                if len(at):
                    near = _matrix(batch.column("v").take(pa.array(at)), d) @ centres.T
                    home = near.argmax(axis=1)
                    best = near[np.arange(len(at)), home]
                    cell[0][at], kind[0][at] = home, np.where(best >= core, CORE, HOME)
                    between = apart[home] if apart is not None else np.linalg.norm(centres[home][:, None] - centres[None], axis=2)
                    who, where = np.nonzero((best[:, None] - near <= chord * between + SLACK) & (np.arange(len(centres))[None] > home[:, None]))
                    row.append(at[who])
                    cell.append(where.astype(np.int32))
                    kind.append(np.full(len(who), VISITOR, np.int8))
                out = batch.take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cell)), pa.array(np.concatenate(kind).astype(np.int32))], names=[*out.schema.names, "cell", "kind"])

    return assign


def _groups(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a matrix of links the smallest number of the group (rows first, then columns) they belong to."""
    r, c = linked.shape
    row, col = np.arange(r), np.arange(r, r + c)
    a, b = np.nonzero(linked)
    while len(a):
        before = row.copy(), col.copy()
        np.minimum.at(col, b, row[a])
        np.minimum.at(row, a, col[b])
        if (before[0] == row).all() and (before[1] == col).all():
            break
    return row, col


def _compare(threshold: float, d_at: int):
    """Links and edges of one pair of blocks: rows (cls, other, links). Edges join each linked vector to one of its group, so they are as few as the rows."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        d = key[d_at].as_py()
        side = np.asarray(table.column("side").combine_chunks())
        cls, n = (np.asarray(table.column(c).combine_chunks()) for c in ("cls", "n"))
        left, right = np.flatnonzero(side < 2), np.flatnonzero(side > 0)  # 0: left, 2: right, 1: a block that meets itself
        v = _matrix(table.column("v"), d)
        linked = v[left] @ v[right].T >= threshold
        if (side == 1).any():
            np.fill_diagonal(linked, False)
        links = [linked @ n[right]]
        who = [cls[left]]
        if not (side == 1).any():
            links.append(n[left] @ linked)
            who.append(cls[right])
        row, col = _groups(linked)
        both = np.concatenate([cls[left], cls[right]])
        root = both[np.concatenate([row, col])]
        edge = np.flatnonzero(root != both)
        links, who = np.concatenate(links).astype(np.int64), np.concatenate(who)
        some = np.flatnonzero(links)
        return pa.table({
            "cls": pa.array(np.concatenate([who[some], both[edge]]), pa.int64()),
            "other": pa.array([None] * len(some) + root[edge].tolist(), pa.int64()),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(edge), np.int64)]), pa.int64()),
        })

    return compare


def _placed(classes: DataFrame, threshold: float, cell_rows: int) -> DataFrame:
    """classes at home in their cells and as visitors: cls, label, v, n, d, cell, kind."""
    dims = classes.groupBy("d").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "d").limit(1).collect()
    d, rows = (dims[0].d, dims[0].rows) if dims else (0, 0)
    cells = int(min(MOST_CELLS, -(-rows // cell_rows), max(1, CENTRE_BYTES // (8 * max(1, d)))))
    centres = centres_of(classes.where(F.col("d") == d), d, cells) if cells > 1 else np.zeros((0, d))
    schema = T.StructType([*classes.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("kind", T.IntegerType())])
    return classes.mapInArrow(_assign(d, centres, threshold), schema)


def vector_groups(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", threshold: float = THRESHOLD,
    cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null (without ``label_col`` all are compared) and their cosine in double precision is at least
    ``threshold`` (over 0.5). n_links counts other rows linked directly, component_id is the smallest id reached by links, kept says whether that is
    the row's own. Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing and are kept; vectors of different lengths
    aren't compared. Rows that repeat a vector, with the same id or not, are linked; they are compared once. Rows that share an id but not
    the vector are different ones. An empty table gives an empty result; other
    columns of vectors are not read.
    """
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).alias("raw"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull()
    rows = unit_vectors(rows.withColumn("raw", F.when(usable, F.col("raw"))), "raw", "v")
    same = rows.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = cut(same.select(F.monotonically_increasing_id().alias("cls"), "label", "v", "least", "n", F.size("v").alias("d")))
    where = ["label", "d", "cell"]
    placed = cut(_placed(classes.select("cls", "label", "v", "n", "d"), threshold, cell_rows))

    # The core of a cell: all linked with each other, without a product.
    core = placed.where(F.col("kind") == CORE).groupBy(*where).agg(F.min("cls").alias("first"), F.sum("n").alias("total"))
    cores = placed.where(F.col("kind") == CORE).select("cls", "n", *where).join(small(cut(core)), where)
    within = cores.select("cls", F.when(F.col("cls") != F.col("first"), F.col("first")).alias("other"), (F.col("total") - F.col("n")).alias("links"))

    # Blocks of each kind, and the pairs of blocks that meet.
    size = F.least(F.lit(block_rows), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (F.col("d") * 8))))
    number = placed.groupBy(*where, "kind").agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / size).cast("int"))
    number = cut(number)
    each = number.select(*where, "kind", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    a, b = each.select(*where, F.col("kind").alias("ka"), F.col("block").alias("ba")), each.select(*where, F.col("kind").alias("kb"), F.col("block").alias("bb"))
    meet = (F.col("ka") > F.col("kb")) & (F.col("ka") != CORE) | (F.col("ka") == HOME) & (F.col("kb") == HOME) & (F.col("ba") <= F.col("bb"))
    pairs = cut(a.join(b, where).where(meet))
    selves = (F.col("ka") == F.col("kb")) & (F.col("ba") == F.col("bb"))
    pair = ["ka", "ba", "kb", "bb"]
    left = pairs.select(*where, *pair, F.col("ka").alias("kind"), F.col("ba").alias("block"), F.when(selves, 1).otherwise(0).alias("side"))
    right = pairs.where(~selves).select(*where, *pair, F.col("kb").alias("kind"), F.col("bb").alias("block"), F.lit(2).alias("side"))
    dealt = placed.join(small(number.select(*where, "kind", "blocks")), [*where, "kind"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).drop("blocks")
    met = dealt.join(left.unionByName(right), [*where, "kind", "block"])
    found = met.groupBy(*where, *pair).applyInArrow(_compare(threshold, 1), "cls long, other long, links long")
    found = cut(found.unionByName(within))

    links = found.where("links > 0").groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    joined = cut(joined.join(classes.select(F.col("cls").alias("node"), "least"), "node"))
    least = cut(joined.groupBy("component").agg(F.min("least").alias("root")))
    roots = joined.select("node", "component").join(small(least), "component").select(F.col("node").alias("cls"), "root")
    told = classes.join(links, "cls", "left").join(roots, "cls", "left")
    told = cut(told.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "least").alias("root")))
    # Rows of one vector are split among tasks where they are many; the other side has one row for each.
    out = rows.join(told, ["label", "v"], "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.col("id").eqNullSafe(root).alias("kept"))


def drop_near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of vectors of which vector_groups keeps the id, with all their columns; rows without an id stay. Repeated rows of a kept id stay together."""
    lost = vector_groups(vectors, id_col, vec_col, label_col, threshold).where("not kept").select(F.col(id_col).alias("_lost")).distinct()
    columns = vectors.columns
    whole = vectors.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_lost"))
    return whole.join(small(cut(lost), BROADCAST_ROWS), "_lost", "left_anti").select("_row.*")
