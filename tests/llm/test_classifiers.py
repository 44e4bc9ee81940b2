import itertools
import math
import random
from itertools import combinations

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from dossia.llm import langid, queries, toxicity
from dossia.llm.common import draw_below, read

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word):
    for n in range(len(word)):
        for cuts in combinations(range(1, len(word)), n):
            yield [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)), strict=True)]


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    pieces = {p: n for n, p in enumerate(["a", "b", "ab", "ba", "aba", "bb"])}
    prob = rng.random((len(pieces) + 1, 3))
    prob /= prob.sum(axis=0)
    words = ["a", "abba", "ababab", "aczb", "b" * 40, "ab" * 30 + "z"]
    got = langid.forward(words, pieces, prob)
    for w, logs in zip(words[:4], got[:4], strict=True):
        want = np.zeros(3)
        for parts in segmentations(w):
            at = [pieces.get(p, len(pieces) if len(p) == 1 else None) for p in parts]
            if None not in at:
                want += prob[at].prod(axis=0)
        assert np.allclose(np.exp(logs), want)
    assert np.allclose(got[4], langid._forward_long(words[4], pieces, np.log(prob)))
    short = langid._forward_long("abba", pieces, np.log(prob))
    assert np.allclose(short, got[1])
    # The expected number of characters covered is the word's length.
    counts = langid.expected(["abab", "b"], np.array([2.0, 1.0]), pieces, prob[:, 0])
    size = np.array([len(p) for p in pieces] + [1])
    assert math.isclose((counts * size).sum(), 9)


def test_language_accuracy_on_held_out(spark, sf_dir):
    got = queries.op2_language_id(spark, sf_dir)
    assert {"doc_id", "held_out", "lang_pred", "score"} <= set(got.columns)
    rows = got.join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    train = spark.createDataFrame([("the cat and the dog " * 5, "en"), ("le chat et le chien " * 5, "fr"), (None, "en"), ("x", None), ("", "fr")], "text string, lang string")
    model = langid.fit(train, PATH)
    assert model.languages == ["en", "fr"]
    docs = [(1, None, "a"), (2, "", "b"), (3, "123 !!", "c"), (4, "the dog", None), (4, "the dog", None), (None, "le chien " * 20_000, "e")]
    got = langid.predict(spark.createDataFrame(docs, "doc_id long, text string, score string"), model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", "fr"] and got[0].score == 0
    nothing = langid.fit(train.limit(0), PATH)
    assert langid.predict(spark.createDataFrame(docs, "doc_id long, text string, x string"), nothing).first().lang_pred == "und"
    assert langid.predict(train.select("text").limit(0), model).collect() == []


def test_all_pieces_and_all_words_count(spark):
    pieces = langid.piece_ids(PATH)
    longest = max(pieces, key=len)
    assert len(longest) == 16
    # A word of a piece of 16 characters is likelier where that piece is.
    prob = np.full((len(pieces) + 1, 2), 1e-6)
    prob[pieces[longest], 1] = 0.01
    logs = langid.forward([longest, longest + longest], pieces, prob)
    assert (logs[:, 1] > logs[:, 0] + 5).all()
    # Words of more than 28 letters are fitted by the same sums as short ones.
    small = {p: n for n, p in enumerate(["a", "b", "ab", "aba"])}
    p = np.array([0.3, 0.3, 0.2, 0.1, 0.1])
    word = "ab" * 16
    short, before = langid.expected([word], np.array([3.0]), small, p), langid._SHORT
    langid._SHORT = 40
    try:
        assert np.allclose(short, langid.expected([word], np.array([3.0]), small, p))
    finally:
        langid._SHORT = before
    train = spark.createDataFrame([("donaudampfschifffahrtsgesellschaften " * 3, "de"), ("the cat", "en")], "text string, lang string")
    model = langid.fit(train, PATH)
    docs = spark.createDataFrame([(1, "Donaudampfschifffahrtsgesellschaften"), (2, "12 \u00bd \u00b2 \u2167 \u2460"), (3, "\u00bd cat")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(docs, model).orderBy("doc_id").collect()] == ["de", "und", "en"]


def test_predictions_match_brute_force(spark):
    rng = random.Random(2)
    vocabulary = {"en": ["the", "cat", "\u00e9t\u00e9", "x" * 31, "word"], "fr": ["le", "chat", "mot", "Etat", "y"]}
    train = [(" ".join(rng.choices(words, k=12)), lang) for lang, words in vocabulary.items() for _ in range(20)]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"), PATH)
    pieces, longest = langid.piece_ids(PATH), 16

    def brute(word):
        word, sums = langid.START + word, [np.array([1.0, 1.0])]
        for end in range(1, len(word) + 1):
            total = np.zeros(2)
            for start in range(max(0, end - longest), end):
                at = pieces.get(word[start:end], len(pieces) if end - start == 1 else None)
                if at is not None:
                    total = total + sums[start] * model.prob[at]
            sums.append(total)
        return np.log(sums[-1])

    texts = [" ".join(rng.choices([*vocabulary["en"], *vocabulary["fr"], "a-b", "q1w", "7"], k=rng.randint(1, 9))) for _ in range(60)]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for text, r in zip(texts, got, strict=True):
        runs = ["".join(run) for k, run in itertools.groupby(text.lower(), str.isalpha) if k for run in [list(run)]]
        logs = sum((brute(w) for w in runs), np.zeros(2))
        if runs:
            assert r.lang_pred == model.languages[int(logs.argmax())] and math.isclose(r.score, 1 / np.exp(logs - logs.max()).sum(), rel_tol=1e-9)
        else:
            assert r.lang_pred == "und"


def test_copies_and_common_languages_dont_fill_the_sample(spark):
    rows = [("one text again and again", "en")] * 500 + [(f"texte num {k}", "fr") for k in range(5)] + [(f"other text {k}", "en") for k in range(50)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), PATH, train_docs=100)
    assert model.languages == ["en", "fr"]


def test_shares_of_samples_dont_round_to_nothing():
    for rows in (10**9, 4 * 10**8 * 20, 10**13):
        below = draw_below(300, rows) + 2**63
        assert abs(below / 2**64 * rows - 300) < 1
    assert draw_below(5, 5) == 2**63 - 1 and draw_below(0, 0) == 2**63 - 1


def test_more_languages_than_are_learned(spark, monkeypatch):
    """A noisy label column: the commonest languages are learned, by rows."""
    rows = [(f"word{k} text{k} more{k}", f"l{k:03d}") for k in range(600)] + [("the cat and the dog", "en"), ("a cat", "en"), ("le chat et le chien", "fr"), ("un chat", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 20)
    model = langid.fit(df, PATH)
    assert len(model.languages) == 20 and {"en", "fr", "l000"} <= set(model.languages) and "l599" not in model.languages
    got = langid.predict(spark.createDataFrame([(1, "the dog"), (2, "le chien")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in got] == ["en", "fr"]


def test_scorer_forgets_by_bytes(monkeypatch):
    prob = np.full((len(langid.piece_ids(PATH)) + 1, 3), 1e-4)
    prob[langid.piece_ids(PATH)["\u2581the"], 1] = 0.1
    texts = [f"the word{k} cat{k}" for k in range(3000)]
    whole = langid._Scorer(langid.LanguageModel(PATH, ["a", "b", "c"], prob)).score(texts)[0]
    monkeypatch.setattr(langid, "REMEMBERED_BYTES", 24_000)
    small = langid._Scorer(langid.LanguageModel(PATH, ["a", "b", "c"], prob))
    assert small.most == 1000
    assert np.allclose(np.concatenate([small.score(texts[k : k + 500])[0] for k in range(0, 3000, 500)]), whole) and len(small.row) < 2500


def test_toxicity_on_held_out(spark, sf_dir):
    got = queries.op3_toxicity(spark, sf_dir)
    rows = got.join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hits = sum(r.predicted for r in rows if r.toxic)
    assert hits > 0.6 * sum(r.toxic for r in rows)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.03 * len(rows)
    assert got.count() == read(spark, sf_dir, "documents").count()
    assert got.where("predicted <> cast(score >= 0.3 as int) or score < 0 or score > 1").count() == 0


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(4)
    clean = [" ".join(rng.choices(["sun", "tree", "road", "house", "river"], k=30)) for _ in range(120)]
    rows = [(t, 0) for t in clean] + [(t + " horrid horrible", 1) for t in clean[:60]] + [(None, 0), ("", None)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    docs = spark.createDataFrame([(1, "sun tree horrid horrible", "x"), (2, None, "y"), (3, "", "z"), (4, "river road " * 30_000, None), (4, "river road " * 30_000, None)], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    assert got[1] > 0.5 > got[4] and got[2] == got[3]
    one_class = toxicity.fit(spark.createDataFrame([("a", 0)], "text string, toxic int"))
    assert toxicity.score_texts(docs, one_class).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.score_texts(docs.limit(0), model).collect() == []


def test_ngrams_stay_within_words():
    at, ends = toxicity.ngrams(["ab", "", "a1cd"])
    # ^ab$ has 4 characters: two of 3, one of 4; ^a$^cd$ is one string of 7.
    assert ends.tolist() == [3, 3, 3 + 5 + 4 + 3 + 2] and len(at) == ends[-1]


def test_copies_are_drawn_one_by_one(spark):
    """One text is half of the rows, and its label is wrong in one row of four; by text alone it would be drawn whole or not at all."""
    rows = [(n, "same words again", int(n % 4 == 0)) for n in range(4000)] + [(n, f"word{n} other", int(n % 2 == 0)) for n in range(4000, 8000)]
    model = toxicity.fit(spark.createDataFrame(rows, "id long, text string, toxic int"), train_docs=400, id_col="id")
    got = toxicity.score_texts(spark.createDataFrame([(1, "same words again")], "id long, text string"), model).first().score
    assert 0.1 < got < 0.45


def test_few_examples_need_no_least_count(spark):
    rows = [(1, "horrid thing", 1), (2, "sunny road", 0), (3, "quiet house", 0)]
    docs = spark.createDataFrame(rows, "id long, text string, toxic int")
    model = toxicity.fit(docs, id_col="id", least_count=1, least_ratio=0.0)
    score = {r.id: r.score for r in toxicity.score_texts(docs, model).collect()}
    assert score[1] > max(score[2], score[3])


def test_marks_belong_to_words():
    at, _ = toxicity.ngrams(["e\u0301ab"])
    assert len(at) == 4 + 3 + 2 + 1


def test_three_labelled_rows_tell_texts_apart(spark):
    rows = [(1, "horrid thing", 1), (2, "sunny road", 0), (3, "quiet house", 0)]
    docs = spark.createDataFrame(rows, "id long, text string, toxic int")
    score = {r.id: r.score for r in toxicity.score_texts(docs, toxicity.fit(docs, id_col="id")).collect()}
    assert score[1] > max(score[2], score[3])


def test_scores_match_a_plain_counter(spark):
    """One fitted model, scored by n-grams counted one at a time."""
    rng = random.Random(5)
    words = ["horrid", "Sun", "t\u00e9l\u00e9", "road-side", "a1b", "\u65e5\u672c", "x" * 40, "e\u0301t"]
    rows = [(" ".join(rng.choices(words[1:], k=12)) + (" horrid horrible" if n % 3 == 0 else ""), int(n % 3 == 0)) for n in range(90)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(40)] + [None, " \n ", "12 !"]

    def bucket(run):
        value = 0
        for c in run:
            value = (value * 0x9E3779B97F4A7C15 + ord(c) + 1) & (2**64 - 1)
        value ^= value >> 29
        value = (value * 0xBF58476D1CE4E5B9 + len(run) - 1) & (2**64 - 1)
        return (value >> 40) % toxicity.BUCKETS

    got = toxicity.score_texts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), model).orderBy("id").collect()
    for text, r in zip(texts, got, strict=True):
        distinct = sorted({w for w in (text or "").lower().split()})
        total = 0.0
        for w in distinct:
            marked = "".join(f"^{run}$" for run in toxicity._LETTERS.findall(w))
            total += sum(model.weight[bucket(marked[k : k + size])] for size in toxicity.SIZES for k in range(len(marked) - size + 1))
        z = total / max(1, len(distinct)) ** 0.5 + model.intercept
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-40, min(40, z)))), abs_tol=1e-8)
    assert len({r.score for r in got}) > 10


def test_labels_meet_texts_by_drawn_ids(spark):
    docs = spark.createDataFrame([(n, f"text {n}") for n in range(5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(4000)] + [(7, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    some = toxicity.labelled_texts(docs, labels, most=500)
    assert 350 < some.count() < 650 and toxicity.labelled_texts(docs, labels).count() == 3999
