import itertools
import random
import re

from dossia.llm import filter_audit, queries
from dossia.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    words = WORD.findall(text)
    return {
        name
        for name, bad in (
            ("A", len(words) < 50),
            ("B", 100 * len(set(words)) < 65 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)),
            ("D", bool(re.search(r"[#$%&*|]", text))),
        )
        if bad
    }


def brute(docs, labels):
    """Every order run filter by filter over lists of documents."""
    rows = [(i, s or "", t or "") for i, t, s in docs]
    failed = [fails(t) | ({"E"} if i is not None and any(j is not None and j < i and u == t for j, _, u in rows) else set()) for i, _, t in rows]
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {s for _, s, _ in rows}:
        mine = [k for k, r in enumerate(rows) if r[1] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            kept = mine
            for step, name in enumerate(order, 1):
                gone = [k for k in kept if name in failed[k]]
                kept = [k for k in kept if name not in failed[k]]
                removed_by[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(name in failed[k] for k in mine) - len(gone), sum(failed[k] == {name} for k in mine),
                    sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def collected(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def documents():
    rng = random.Random(8)
    words = ["plain", "words", "Up", "UPPER", "été", "a#b", "x\x1fy", "z z", "100%"]
    texts = [rng.choice(" \n\t").join(rng.choices(words[: rng.randint(2, 9)] + [f"w{k}" for k in range(rng.choice([0, 300]))], k=rng.choice([3, 49, 50, 80]))) for _ in range(60)]
    rows = [(n, rng.choice(texts), rng.choice(["a", "b", "", None])) for n in range(400)] + [(7, texts[0], "a"), (7, texts[0], "a"), (None, texts[0], "b"), (500, None, "a"), (501, "", "a")]
    rows += [(1000 + n, "one hot text " * 40, "hot") for n in range(300)] + [(2000, "long wordA " * 60_000, "b")]
    labels = [(rng.randrange(420), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(200)] + [(None, 1, 1), (2000, 1, 0)]
    return rows, labels


def test_matches_brute_force(spark):
    rows, labels = documents()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mask int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(df, marks)
    assert collected(got) == brute(rows, labels)


def test_blocks_and_collisions(spark, monkeypatch):
    """Small blocks send the same text many times; one fingerprint for all texts makes one chain of them all."""
    rows, _ = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    want = sorted(filter_audit.failure_masks(df).collect(), key=repr)
    assert sorted(filter_audit.failure_masks(df, block_bytes=500).collect(), key=repr) == want
    chains = {}
    texts = [b"x", b"y", b"x", b"x", b"y"]
    out = [r for n, t in zip((5, 3, 2, 9, 3), texts, strict=True) for r in filter_audit._settle(chains, 1, t, [(n, "s", 0)])]
    assert out == [(5, "s", 16), (9, "s", 16)]
    assert [(t, least, len(waiting)) for t, least, waiting in chains[1]] == [(b"x", 2, 1), (b"y", 3, 2)]


def test_a_hot_text_travels_once_a_block(spark):
    rows = [(n, b"s", b"the same text") for n in range(1000)]
    sent = list(filter_audit._send(1 << 20)(rows))
    assert sum(text is not None for _, (text, _) in sent) == 1 and len(sent) == 1000
    assert len({key % 16 for key, (text, _) in sent if text is None}) == 16


def test_empty_tables_and_other_ids(spark):
    docs = spark.createDataFrame([("b", "t", None), ("a", "t", "s")], "doc_id string, text string, source string")
    marks = spark.createDataFrame([("a", 1, 1)], "doc_id string, quality int, toxic int")
    assert filter_audit.filter_audit(docs.limit(0), marks).collect() == []
    got = collected(filter_audit.filter_audit(docs, marks.limit(0)))
    assert len(got) == 2 * 120 * 5 and got["", "EABCD", 1] == (0, 1, 0, 0, 0, 0, 60) and got["s", "EABCD", 1][1] == 0


def test_query_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in read(spark, sf_dir, "documents").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in read(spark, sf_dir, "labels").collect()]
    assert collected(queries.op12_filter_audit(spark, sf_dir)) == brute(docs, labels)
