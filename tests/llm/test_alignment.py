import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossia.llm import queries, token_alignment
from dossia.llm.common import read

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["the ", "internationalisation", "  ", "\n", " \n ", "\t", "don't", "été", "Größe", "한국어", "日本語", "😀", "<|endoftext|>", "<s>", "</s>", "▁", "<0x41>", "3.14", "\x00", " ", "　", "ﬁ", "á", "...", "((", " x"]


@pytest.fixture(scope="module")
def sides():
    return brute_sides()


def brute_sides():
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    from tokenizers.pre_tokenizers import ByteLevel  # noqa: F401 (the byte alphabet is the library's)

    return library, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_table():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            table[chr(256 + n)] = b
            n += 1
    return table


BYTE_OF = byte_table()


def tokens(text, sides):
    """Ids and bytes of both sides, or nothing if a side loses bytes."""
    if not text:
        return [], []
    library, sp = sides
    a = [(i, bytes(BYTE_OF[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(t for _, t in a) == want == b"".join(t for _, t in b) else ([], [])


def ends(side):
    at, out = 0, []
    for i, t in side:
        at += len(t)
        out.append((at, i))
    return out


def brute(texts, sides):
    """One row for each text by byte offsets alone, without a transducer."""
    rows, count = [], Counter()
    for text in texts:
        a, b = (ends(s) for s in tokens(text, sides))
        common = sorted({x for x, _ in a} & {x for x, _ in b})
        links = [(i, j) for x, i in a for y, j in b if x == y] if len(a) < 500 else list(zip([i for x, i in a if x in set(common)], [j for y, j in b if y in set(common)], strict=True))
        groups, start = [], 0
        for c in common:
            groups.append("|".join(",".join(str(i) for x, i in s if start < x <= c) for s in (a, b)))
            start = c
        count.update(links)
        rows.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in rows
    ]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_matches_brute_force(spark, sides):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(400)] + [None, "", " ", "   ", "same text", "same text", "x" * 3000, "word " * 400]
    df = spark.createDataFrame([(n, t, 7) for n, t in enumerate(texts)] + [(None, "no id", 1), (4, "again", 1)], "doc_id long, text string, n_a int").repartition(3)
    got = token_alignment.aligned_scores(df, A, B, keep_groups=True).collect()
    rows = df.collect()
    want = brute([r.text for r in rows], sides)
    assert sorted((r.doc_id, *(r[n] for n in NAMES)) for r in got if r.doc_id is not None) == sorted((r.doc_id, *w) for r, w in zip(rows, want, strict=True) if r.doc_id is not None)
    assert sum(r.doc_id is None for r in got) == 1 and all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.n_a)
    assert sum(r.n_a == 0 for r in got) > 3 and sum(r.n_groups < r.n_a for r in got) > 50


def test_query_on_whole_documents(spark, sf_dir, sides):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in queries.op11_token_alignment(spark, sf_dir).collect()}
    short = [r for r in docs if len(r.text or "") < 3000]
    want = brute([r.text for r in docs], sides) if len(docs) <= 300 else None
    assert len(got) == len(docs)
    for k, r in enumerate(short[:150] if want is None else docs):
        alone = want[k] if want else brute([r.text], sides)[0]
        at = (0, 1, 2, 3, 6) if want is None else range(7)  # counts of pairs are the corpus's
        assert [got[r.doc_id][i] for i in at] == [alone[i] for i in at]
    total = Counter()
    for r in docs:
        total["a"] += len(tokens(r.text, sides)[0])
    assert total["a"] == sum(g[0] for g in got.values())


def test_transitions_are_remembered_by_residual_and_token():
    al = token_alignment.Aligner(A, B)
    text = " internationalisation"
    a, b = al.a.encode_ordinary(text), al.b.encode(text[1:])
    assert al.groups(a, b)[-1] == (len(a), len(b)) and len(al.memo) == len(a) + len(b)
    before = dict(al.memo)
    assert al.groups(a * 2, b * 2)[-1] == (2 * len(a), 2 * len(b)) and al.memo == before
    assert al.groups(a, b[:-1]) is None and al.groups(a[:-1], b) is None and al.groups(b, a) is None
    assert {r for s, r in al.states if r} and al.states[0] == (0, b"")


def test_forgetting_changes_nothing(monkeypatch):
    texts = [" ".join(f"word{k}x{n}" for k in range(30)) for n in range(20)]
    whole = list(token_alignment.Aligner(A, B).align(texts))
    monkeypatch.setattr(token_alignment, "REMEMBERED", 10)
    monkeypatch.setattr(token_alignment, "TRANSITIONS", 5)
    al = token_alignment.Aligner(A, B)
    assert [x for t in texts + texts for x in al.align([t])] == whole + whole


def test_possible_pairs_hold_all_links():
    a, b = [b"ab", b"b", None, b"c"], [b"b", b"xab", None, b"ab"]
    pairs = [(k >> 32, k & 0xFFFFFFFF) for k in token_alignment.possible_pairs(a, b).tolist()]
    assert pairs == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x))]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.aligned_scores(df, A, B).collect() == []
    ids = spark.createDataFrame([("x", None)], "doc_id string, text string")
    assert token_alignment.aligned_scores(ids, A, B).select("doc_id", F.col("count_sum")).first() == ("x", 0)
