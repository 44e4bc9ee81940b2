import random

import numpy as np

from dossia.llm import embedding_dedup, queries
from dossia.llm.common import read


def brute(rows, threshold=0.98):
    """id, n_links, component_id, kept of each row, all pairs compared; rows of one id and vector are rows of their own."""
    def usable(i, label, v):
        return i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = [[] for _ in rows]
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max() if usable(i, label, v) else None for i, label, v in rows]
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][1] == rows[b][1] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                links[a].append(b)
                links[b].append(a)
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                for b in links[todo.pop()]:
                    if b not in group:
                        group.add(b)
                        todo.append(b)
            seen |= group
            ids = [rows[g][0] for g in group if rows[g][0] is not None]
            for g in group:
                least = min(ids) if ids else None
                out[g] = (rows[g][0], len(links[g]), least, rows[g][0] == least)
    return sorted(out, key=repr)


def vectors(n=900, d=24):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(8, d))
    rows = []
    for k in range(n):
        kind = k % 6
        if kind == 0:  # close copies: a core
            v = centre[0] + rng.normal(size=d) * 0.02
        elif kind == 1:  # near the threshold: chains
            v = centre[1] + rng.normal(size=d) * 0.14 * np.linalg.norm(centre[1]) / d**0.5
        elif kind == 2:
            v = centre[2]
        else:
            v = centre[rng.integers(3, 8)] + rng.normal(size=d) * rng.choice([0.05, 0.3, 1.0])
        rows.append((1000 - k, int(rng.integers(0, 2)), [float(x) for x in v]))
    odd = [(2000, 1, None), (2001, 1, []), (2002, 1, [0.0] * d), (2003, None, rows[0][2]), (2004, 1, [None] + [1.0] * (d - 1)), (2005, 0, [float("nan")] * d),
           (2006, 0, [float("inf")] + [1.0] * (d - 1)), (None, 1, rows[2][2]), (2007, 1, [1.0, 2.0]), (2008, 1, [2.0, 4.0]), (2009, 0, [1e300] * d), (2010, 0, [1e-300] * d),
           (3000, 1, rows[0][2]), (3000, 1, rows[0][2]), (3000, 0, rows[1][2])]
    return rows + odd


def told(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_matches_brute_force_over_many_cells_and_blocks(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, True) for r in rows], "vec_id long, label int, embedding array<double>, kept boolean").repartition(5)
    want = brute([(i, label, v) for i, label, v in rows])
    # Rows of one id count as one in components, like vertices.
    got = told(embedding_dedup.vector_groups(df, cell_rows=60, block_rows=40))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x for x in got if x[0] != 3000] == [x for x in want if x[0] != 3000]
    assert max(x[1] for x in got) > 60


def test_cells_cores_and_visitors_occur(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, label int, embedding array<double>")
    unit = embedding_dedup.unit_vectors(df.where("label is not null"), "embedding", "v").where("v is not null")
    from pyspark.sql import functions as F

    classes = unit.select(F.monotonically_increasing_id().alias("cls"), "label", "v", F.lit(1).cast("long").alias("n"), F.size("v").alias("d"))
    placed = embedding_dedup._placed(classes, 0.98, 60).toPandas()
    assert placed[placed.kind < 2].cls.nunique() == len(placed[placed.kind < 2]) == classes.count()
    assert placed.cell.nunique() > 4 and set(placed.kind) == {0, 1, 2}
    assert len(placed[placed.kind == 2]) < 5 * len(classes.columns) * len(placed)


def test_a_hot_group_is_counted_without_products(spark, monkeypatch):
    """A third of all rows are close copies of one vector: they lie in one core, which meets itself in no pair of blocks."""
    rng = np.random.default_rng(2)
    hot, d = rng.normal(size=16), 16
    rows = [(n, 1, (hot + rng.normal(size=d) * 0.002).tolist() if n % 3 == 0 else rng.normal(size=d).tolist()) for n in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.vector_groups(df, cell_rows=300).collect()}
    assert all(got[n].n_links >= 999 and got[n].component_id == 0 for n in range(0, 3000, 3)) and sum(r.kept for r in got.values()) >= 1990


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert told(embedding_dedup.vector_groups(df, label_col=None)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert embedding_dedup.vector_groups(df.limit(0), label_col=None).collect() == []
    left = embedding_dedup.drop_near_vectors(df.withColumn("_lost", df.vec_id), label_col=None)
    assert left.columns == ["vec_id", "embedding", "_lost"] and sorted(r.vec_id for r in left.collect()) == [1, 3]


def test_query_matches_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.label, r.embedding) for r in read(spark, sf_dir, "embeddings").collect()]
    assert told(queries.op13_embedding_dedup(spark, sf_dir)) == brute(rows)


def test_random_ids_and_ties(spark):
    rng = random.Random(9)
    rows = [(n, rng.choice([0, None, 1]), [float(rng.choice([0, 1, 1, 2])) for _ in range(3)]) for n in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert told(embedding_dedup.vector_groups(df, cell_rows=10, block_rows=7)) == brute(rows)
