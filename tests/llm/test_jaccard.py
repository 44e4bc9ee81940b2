import random
import re

from dossia.llm import jaccard_join

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, component_id string"


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def shingles(t, width):
    w = WORDS.findall(lower(t or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, *_) in enumerate(rows)), key=repr)


def run(spark, rows, width=5, percent=75, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, width=width, percent=percent, **more).collect()), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 30))
    common = [word() for _ in range(30)]
    rows, n = [], 0
    for _ in range(40):
        base = [word() for _ in range(int(4 ** rng.uniform(0, 4.6)))]
        if rng.random() < 0.4:
            base = base + common
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                k = rng.randrange(len(t))
                t[k : k + rng.choice([0, 1, 1, 2])] = [word()] if rng.random() < 0.7 else []
            rows.append((n, (" " if rng.random() < 0.5 else "\n").join(t if rng.random() < 0.5 else [x.upper() for x in t]), "x"))
            n += 1
    rows += [(None, rows[0][1], "x"), (None, "only here once", "x"), (7, rows[7][1], "x"), (7, rows[9][1], "x"), (900, None, "x"), (901, " \n", "x"), (902, "É a b", "x"), (903, "é a b", "x")]
    rng.shuffle(rows)
    assert run(spark, rows, bucket_bytes=5000) == brute(rows, 5, 75)
    assert run(spark, rows[:150], width=2, percent=60) == brute(rows[:150], 2, 60)


def test_signatures_keep_the_guarantee():
    """Pairs just similar enough share a signature, at all sizes and with any spread over partitions."""
    import numpy as np

    rng = np.random.default_rng(1)
    none = np.zeros(jaccard_join.SLOTS, np.uint8)
    for size in [*range(1, 80), 100, 191, 192, 255, 256, 400, 1023, 1100]:
        for _ in range(6):
            more = int(rng.integers(0, size // 3 + 1))
            top = size + more
            shared = -(-75 * (size + top) // 175)
            if shared > size or 100 * shared < 75 * (size + top - shared):
                continue
            words = [f"w{k}" for k in rng.integers(0, 1 << 40, shared + (size - shared) + (top - shared)).tolist()]
            x, y = words[:size], words[:shared] + words[size:]
            sets = jaccard_join.Shingles([" ".join(x).encode(), " ".join(y).encode()], 1)
            text, sig = jaccard_join.signatures(sets, np.arange(2), 75, none)
            assert set(sig[text == 0].tolist()) & set(sig[text == 1].tolist()), (size, top)


def test_large_group_and_empty_table(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for n in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(200)] = f"x{n}"
        rows.append((n, " ".join(t), None))
    assert run(spark, rows) == brute(rows, 5, 75)
    assert run(spark, []) == []


def test_noisy_copies_and_a_common_passage(spark):
    """Groups of far more than a window's sets, in which some are linked, some nearly so and most not at all."""
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randint(0, 10**6))
    base, passage = [word() for _ in range(110)], [word() for _ in range(70)]
    rows = []
    for n in range(260):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8, 10])):
            t[rng.randrange(len(t))] = word()
        rows.append((n, " ".join(t), "a"))
    for n in range(260, 420):
        rows.append((n, " ".join([word() for _ in range(rng.randint(8, 60))] + passage), "b"))
    rows += [(500 + n, rows[3][1], "c") for n in range(60)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows, 5, 75)
    assert run(spark, rows, bucket_bytes=20_000) == brute(rows, 5, 75)


def test_pairs_of_crowded_groups_stay_few(spark):
    """Sets that share a passage with 300 others, and little else, give no pairs to compare."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    word = lambda: "w" + str(rng.randint(0, 10**9))
    passage = [word() for _ in range(90)]
    rows = [(n, " ".join([word() for _ in range(45)] + passage), "") for n in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), "text")
    corpus = jaccard_join._Corpus(docs, 5, 75)
    found = corpus.candidates(2)
    many = found.where("kind = 1").select(F.col("a").alias("print"), "n").distinct().withColumn("component", F.col("print"))
    assert many.count() > 200
    assert corpus.second(many).count() < 300
    assert found.where("kind = 0").count() < 300 * 2 * jaccard_join.WINDOW
