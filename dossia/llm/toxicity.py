"""Toxicity by a linear classifier over character n-grams, whose features are scaled by naive Bayes log-count ratios.

A text's feature for an n-gram is the number of its distinct words that hold it, times the n-gram's log-count ratio between
toxic and other training texts, divided by the square root of the number of distinct words. Logistic regression weighs the features.
As features add up over words, a worker scores each distinct word once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossia.llm.bpe import by_block
from dossia.llm.common import cut, drawn, give_back, small

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 18
#: Bounds of the fit: documents taken from the labelled ones by a hash of id and text, in parts of at least so many that are fitted apart and averaged.
TRAIN_DOCS = 12_000
PART_DOCS = 2_000
STEPS = 150
PENALTY = 2e-4
#: Ratios of n-grams rarer than this in a sample of TRAIN_DOCS (in proportion less in smaller ones), or nearer to 0, count as 0; parameters of fit().
LEAST_COUNT = 4
LEAST_RATIO = 0.4
THRESHOLD = 0.3
BLOCK_BYTES = 2_000_000
REMEMBERED = 200_000
#: Words whose n-grams are looked at at once.
WORDS_AT_ONCE = 20_000

_LETTERS = regex.compile(r"[\p{L}\p{M}]+")


def distinct_words(text: str) -> set[str]:
    return set(text.lower().split())


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word's letter runs (with marks for their ends), one word after another, and where each word's end."""
    marked = ["".join(f"^{r}$" for r in _LETTERS.findall(w)) for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    ends = np.cumsum(size)
    end_of = np.repeat(ends, size)  # of the word at each character
    word_of = np.repeat(np.arange(len(words)), size)
    hashed, at = [], []
    value = np.zeros(len(code), dtype=np.uint64)
    for k in range(max(SIZES)):
        value = value * np.uint64(0x9E3779B97F4A7C15)
        value[: max(0, len(code) - k)] += code[k:] + np.uint64(1)
        if k + 1 in SIZES:
            inside = np.flatnonzero(np.arange(len(code)) + k < end_of)
            v = value[inside] ^ (value[inside] >> np.uint64(29))
            v = v * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
            hashed.append((v >> np.uint64(40)).astype(np.int64) % BUCKETS)
            at.append(word_of[inside])
    at, hashed = np.concatenate(at), np.concatenate(hashed)
    order = np.argsort(at, kind="stable")
    return hashed[order], np.cumsum(np.bincount(at, minlength=len(words)))


def word_sums(words: list[str], weight: np.ndarray) -> np.ndarray:
    """For each word the sum of its n-grams' weights."""
    out = np.zeros(len(words))
    for lo in range(0, len(words), WORDS_AT_ONCE):
        at, ends = ngrams(words[lo : lo + WORDS_AT_ONCE])
        total = np.concatenate([[0.0], np.cumsum(weight[at])])
        out[lo : lo + WORDS_AT_ONCE] = total[ends] - total[np.concatenate([[0], ends[:-1]])]
    return out


@dataclass
class ToxicityModel:
    """Weight of each n-gram bucket (ratio times coefficient) and the intercept."""

    weight: np.ndarray
    intercept: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _class_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per class the n-gram counts of a task's texts, cut into 64 rows."""
    counts = np.zeros((2, BUCKETS))
    for batch in batches:
        for label, texts in batch.groupby("label")["text"]:
            words: dict[str, int] = {}
            for t in texts:
                for w in distinct_words(t):
                    words[w] = words.get(w, 0) + 1
            named, often = list(words), np.fromiter(words.values(), np.int64, len(words))
            for lo in range(0, len(named), WORDS_AT_ONCE):
                at, ends = ngrams(named[lo : lo + WORDS_AT_ONCE])
                times = np.repeat(often[lo : lo + WORDS_AT_ONCE], np.diff(ends, prepend=0))
                counts[int(label)] += np.bincount(at, weights=times, minlength=BUCKETS)
    give_back()
    for k, part in enumerate(np.split(counts, 64, axis=1)):
        yield pd.DataFrame({"k": [k], "counts": [part.ravel().tolist()]})


def _fit_part(ratio: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on all rows of a part; only n-grams with a ratio take part."""
    which, value, size = [], [], []
    for text in rows["text"]:
        words = list(distinct_words(text))
        at = ngrams(words)[0] if words else np.zeros(0, np.int64)
        at = at[ratio[at] != 0]
        bucket, count = np.unique(at, return_counts=True)
        which.append(bucket.astype(np.int32))
        value.append(count * ratio[bucket] / np.sqrt(max(1, len(words))))
        size.append(len(bucket))
    col, y = np.concatenate(which), rows["label"].to_numpy(float)
    del which
    value, doc = np.concatenate(value), np.repeat(np.arange(len(size), dtype=np.int32), size)
    met = np.zeros(BUCKETS, dtype=bool)
    met[col] = True
    used, col = np.flatnonzero(met), (np.cumsum(met, dtype=np.int32) - 1)[col]
    w, b = np.full(len(used), 0.02), -2.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(doc, weights=value * w[col], minlength=len(y)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g, gb = np.bincount(col, weights=value * error[doc], minlength=len(used)) + PENALTY * w, error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 * (1 - step / (STEPS + 1)) + 0.002
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    out = np.zeros(BUCKETS)
    out[used] = w * ratio[used]
    return out, float(b)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS, id_col: str | None = None,
        least_count: int = LEAST_COUNT, least_ratio: float = LEAST_RATIO) -> ToxicityModel:
    """A model of about ``train_docs`` labelled rows chosen by a hash of the text, with ``id_col`` of id and text, so that copies are drawn and
    dealt to parts one by one. Rows with a null label are no examples; null texts are empty; repeated rows are drawn together. n-grams rarer than
    ``least_count`` are left out of a sample of TRAIN_DOCS, in smaller samples those rarer than that share of it.

    Without examples of both classes all texts score the share of label 1 (0 without any example).
    """
    spot = F.xxhash64(*([id_col] if id_col else []), text_col)
    rows = labelled.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"), spot.alias("drawn")).where("label in (0, 1)")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < n:
        share = ones / n if n else 0.0
        return ToxicityModel(np.zeros(BUCKETS), 40.0 if share else -40.0)
    number = max(1, min(n, train_docs) // PART_DOCS)
    chosen = rows.where(drawn(F.col("drawn"), train_docs, n)).repartition(number, F.xxhash64("drawn", F.lit(1)))
    total = F.expr("aggregate(all, array_repeat(0D, size(all[0])), (a, x) -> zip_with(a, x, (p, q) -> p + q))")
    parts = chosen.mapInPandas(_class_counts, "k int, counts array<double>").groupBy("k").agg(F.collect_list("counts").alias("all"))
    counts = np.zeros((2, BUCKETS))
    for r in parts.select("k", total.alias("counts")).collect():  # 64 rows of a fixed size
        counts[:, r.k * (BUCKETS // 64) : (r.k + 1) * (BUCKETS // 64)] = np.array(r.counts).reshape(2, -1)
    toxic, other = counts[1] + 1, counts[0] + 1
    ratio = np.log((toxic / toxic.sum()) / (other / other.sum()))
    least_count *= min(1.0, min(n, train_docs) / TRAIN_DOCS)
    ratio[(counts.sum(axis=0) < least_count) | (np.abs(ratio) < least_ratio)] = 0
    sent = chosen.sparkSession.sparkContext.broadcast(ratio)

    def learn(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        weight, intercept = _fit_part(sent.value, part)
        give_back()
        return pd.DataFrame({"n": [len(part)], "weight": [weight.astype("<f4").tobytes()], "intercept": [intercept]})

    by_part = chosen.groupBy(F.pmod(F.xxhash64("drawn", F.lit(2)), F.lit(number)).alias("part"))
    fitted = by_part.applyInPandas(learn, "n long, weight binary, intercept double").collect()  # one row of a fixed size for each part
    rows_fitted = sum(r.n for r in fitted)
    weight = sum(np.frombuffer(r.weight, "<f4").astype(float) * r.n for r in fitted) / rows_fitted
    return ToxicityModel(weight, sum(r.intercept * r.n for r in fitted) / rows_fitted)


class _Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, {}

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = [distinct_words(t) for t in texts]
        new = [w for w in set().union(*words) if w not in self.known]
        self.known.update(zip(new, word_sums(new, self.model.weight).tolist(), strict=True))
        get = self.known.__getitem__
        z = np.array([sum(map(get, sorted(ws))) / max(1, len(ws)) ** 0.5 for ws in words]) + self.model.intercept
        return np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 9)


_scorers: dict[str, _Scorer] = {}


def _scorer(model: ToxicityModel) -> _Scorer:
    if model.key not in _scorers:
        _scorers.clear()
        _scorers[model.key] = _Scorer(model)
    return _scorers[model.key]


def score_texts(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with a score from 0 to 1 for each whole text; null counts as empty. A column of that name is replaced, the others stay.

    Rows are scored on their own: repeated ones alike, texts of any length whole; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c != out_col and (keep_text or c != text_col)]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in kept), T.StructField(out_col, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for batch in batches:
            texts = batch.column(text_col)
            for rows in by_block(np.asarray(pc.binary_length(texts.fill_null(""))), BLOCK_BYTES):
                size = rows.stop - rows.start
                score = scorer.score([t or "" for t in texts.slice(rows.start, size).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(rows.start, size) for c in kept), pa.array(score)], names=[*kept, out_col])
        give_back()

    return docs.mapInArrow(run, schema)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 4 * TRAIN_DOCS) -> DataFrame:
    """_id, text and label of documents with one label; ids with more than one label are no examples.

    About ``most`` ids are drawn by their hash from all labelled ones before they meet the documents, so they are broadcast and no text is shuffled.
    """
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.max(label_col).alias("label"), F.min(label_col).alias("_least")
    ).where("label = _least").select(F.col(id_col).alias("_id"), "label")
    one = cut(one)
    one = cut(one.where(drawn(F.xxhash64("_id"), most, one.count())))
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(small(one), "_id")
