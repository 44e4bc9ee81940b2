import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dossia.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aab'strevmdl ΑΣσ<|endoftext|>é\u0301\u0307İ\x1c\x85\xa0\u3000\n\t12²Ⅷ!#😀字ﬁ한글가\u200b"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n):
    rng = random.Random(1)
    ends = ["", "<|endoftext|>", " <|startoftext|>x", "'S'RE"]
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) + rng.choice(ends) for _ in range(n)]


def test_matches_the_library(spark, library, monkeypatch):
    rows = list(enumerate(texts(1500))) + [(9001, None), (9002, ""), (9003, "a" * 200_000), (9003, "a" * 200_000), (None, "null id")]
    df = spark.createDataFrame([(i, t, "kept", [7]) for i, t in rows], "doc_id long, text string, decoded string, ids array<int>").repartition(3)
    got = bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH)
    assert set(got.columns) == set(df.columns)
    for r in got.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_overlaps_and_forgetting(library):
    model = bpe.PairIndexBpe(PATH)
    words = ["aaaaaaa", "ababababab", "lalalala", "hahahahaha", "ssssss"]
    for _ in range(2):
        got = model.encode(words)
        assert [len(x) // 4 for x in got] == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
        model.known.clear()


def test_decode_of_odd_rows(spark, library):
    df = spark.createDataFrame([([320, None, 999999, 49407],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.bpe_decode(df, PATH).collect()] == ["a</w> <|endoftext|>", "", ""]
    assert bpe.bpe_decode(df, PATH, skip_special=True).first().decoded == "a</w>"
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_decode(bpe.bpe_encode(empty, PATH), PATH).collect() == []
