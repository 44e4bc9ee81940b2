import random
import re

from dossia.llm import substring

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, n_words string"


def brute(rows, window):
    seen, out = {}, []
    big = float("inf")
    docs = [(big if i is None else i, WORDS.findall(t or "")) for i, t, *_ in rows]
    for i, ws in docs:
        for k in range(len(ws) - window + 1):
            w = tuple(ws[k : k + window])
            seen[w] = min(seen.get(w, (big, big)), (i, k))
    for i, ws in docs:
        gone = set()
        for k in range(len(ws) - window + 1):
            if seen[tuple(ws[k : k + window])] < (i, k):
                gone.update(range(k, k + window))
        out.append((None if i == big else i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=repr)


def run(spark, rows, window, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = substring.substring_dedup(df, window=window, **more)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=repr)


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["a", "b", "cé", "d\0", "e" * 60, "f"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 30))] for _ in range(8)]
    rows = []
    for i in range(120):
        words = [w for _ in range(rng.randint(0, 5)) for w in (rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(9)])]
        rows.append((i, rng.choice([" ", "\n", "  ", "\x0b"]).join(words), "x"))
    rows += [(3, rows[3][1], "x"), (3, rows[4][1], "x"), (None, rows[5][1], "y"), (200, None, None), (201, "", "z"), (202, "\x1c\x85", None)]
    for window in (4, 7, 20):
        assert run(spark, rows, window, bucket_bytes=700) == brute(rows, window)


def test_long_text_and_empty_table(spark):
    text = "w " * 60_000 + " ".join(map(str, range(30_000)))
    (row,) = run(spark, [(1, text, None)], 20)
    assert row[1] == 90_000 and row[2] == 59_999
    assert run(spark, [], 20) == []
