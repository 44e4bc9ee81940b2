"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. The probability of a word is the sum over all its
segmentations into pieces of the product of the pieces' probabilities, had by a forward algorithm for all languages at
once; the probabilities are fitted by expectation-maximisation (forward-backward) over word counts per language.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossia.llm.bpe import by_block
from dossia.llm.common import cut, draw_below
from dossia.llm.wordhash import Words

UND = "und"
#: Bounds of the fit: documents taken from the labelled ones, in equal parts from all languages and by a hash of their texts, and rounds.
TRAIN_DOCS = 6_000
ROUNDS = 3
#: The model holds a probability of each piece for each language: the commonest languages are learned, so many at most.
MOST_LANGUAGES = 500
SMOOTHING = 0.05
START = "▁"  # what the vocabulary writes for a word's start
BLOCK_BYTES = 4_000_000
REMEMBERED = 400_000
REMEMBERED_BYTES = 128 << 20

_LETTERS = regex.compile(r"\p{L}+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are taken one at a time in logarithms.
_SHORT = 28


@functools.lru_cache(2)
def piece_ids(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece model without control and byte pieces; the id after the last is for other characters."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = (p for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)) for p in [sp.id_to_piece(i)])
    return {p: n for n, p in enumerate(sorted(set(usable)))}


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _edges(words: list[str], pieces: dict[str, int]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By (end, length): the words with a piece there, and the piece. A character without a piece of its own has the last id.

    Runs of characters are told by 64-bit hashes, one length after another over all words.
    """
    by_size: dict[int, list[str]] = {}
    for p in pieces:
        by_size.setdefault(len(p), []).append(p)
    size = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(size, size) - place  # characters from here to the word's end
    code = _codes(words) + np.uint64(1)
    value, found = np.zeros(len(code), dtype=np.uint64), {}
    for length in range(1, min(max([1, *by_size]), int(size.max(initial=0))) + 1):
        value = value * _ODD
        value[: len(code) - length + 1] += code[length - 1 :]
        at = np.flatnonzero(left >= length)
        names = by_size.get(length, [])
        known = _codes(names).reshape(-1, length) + np.uint64(1)
        hashes = np.zeros(len(names), dtype=np.uint64)
        for k in range(length):
            hashes = hashes * _ODD + known[:, k]
        order = np.argsort(hashes)
        ids = np.array([pieces[p] for p in names], dtype=np.int64)[order]
        hashes, run = hashes[order], value[at]
        near = np.minimum(np.searchsorted(hashes, run), max(0, len(names) - 1))
        hit = hashes[near] == run if len(names) else np.zeros(len(at), dtype=bool)
        piece = np.where(hit, ids[near], len(pieces)) if len(names) else np.full(len(at), len(pieces))
        if length > 1:
            at, piece = at[hit], piece[hit]
        end = place[at] + length
        order = np.argsort(end, kind="stable")
        at, piece, end = at[order], piece[order], end[order]
        cuts = np.flatnonzero(np.diff(end, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            found[int(end[lo]), length] = (word[at[lo:hi]], piece[lo:hi])
    return dict(sorted(found.items()))


def _ways(word: str, pieces: dict[str, int], longest: int) -> Iterator[tuple[int, int, int]]:
    """start, end, piece of each piece in one word of any length, by ascending end."""
    other = len(pieces)
    for end in range(1, len(word) + 1):
        for size in range(1, min(end, longest) + 1):
            p = pieces.get(word[end - size : end], other if size == 1 else -1)
            if p >= 0:
                yield end - size, end, p


def forward(words: list[str], pieces: dict[str, int], prob: np.ndarray) -> np.ndarray:
    """Logarithm of each word's probability in each language (prob: pieces and the other characters x languages)."""
    out = np.zeros((len(words), prob.shape[1]))
    size = np.fromiter(map(len, words), np.int64, len(words))
    # Words of one length or so at a time: short ones, which are most, take few steps.
    for low, high in ((0, 8), (8, 12), (12, 18), (18, _SHORT)):
        at_once = np.flatnonzero((size > low) & (size <= high))
        if len(at_once):
            chosen = [words[n] for n in at_once.tolist()]
            alpha = np.zeros((high + 1, len(chosen), prob.shape[1]))
            alpha[0] = 1
            for (end, length), (at, piece) in _edges(chosen, pieces).items():
                alpha[end, at] += alpha[end - length, at] * prob[piece]
            out[at_once] = np.log(alpha[size[at_once], np.arange(len(chosen))])
    logs = np.log(prob)
    for n in np.flatnonzero(size > _SHORT).tolist():
        out[n] = _forward_long(words[n], pieces, logs)
    return out


def _forward_long(word: str, pieces: dict[str, int], logs: np.ndarray) -> np.ndarray:
    return _beginnings(word, pieces, logs)[-1]


def _beginnings(word: str, pieces: dict[str, int], logs: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities of all beginnings of one word of any length, in each language."""
    alpha = np.full((len(word) + 1, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for start, end, p in _ways(word, pieces, max(map(len, pieces), default=1)):
        alpha[end] = np.logaddexp(alpha[end], alpha[start] + logs[p])
    return alpha


def expected(words: list[str], counts: np.ndarray, pieces: dict[str, int], prob: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of the words, times the words' counts (one language)."""
    out = np.zeros(len(prob))
    length = np.array([len(w) for w in words])
    short = np.flatnonzero(length <= _SHORT)
    if len(short):
        length_s, n = length[short], np.arange(len(short))
        edges, most = _edges([words[k] for k in short.tolist()], pieces), int(length_s.max())
        alpha, beta = np.zeros((most + 1, len(short))), np.zeros((most + 1, len(short)))
        alpha[0] = 1
        beta[length_s, n] = 1
        for (end, size), (at, piece) in edges.items():
            alpha[end, at] += alpha[end - size, at] * prob[piece]
        for (end, size), (at, piece) in sorted(edges.items(), key=lambda e: -e[0][0]):
            beta[end - size, at] += prob[piece] * beta[end, at]
        total = alpha[length_s, n]
        for (end, size), (at, piece) in edges.items():
            out += np.bincount(piece, alpha[end - size, at] * prob[piece] * beta[end, at] / total[at] * counts[short][at], len(out))
    logs = np.log(prob)[:, None]
    for k in np.flatnonzero(length > _SHORT).tolist():
        alpha, ways = _beginnings(words[k], pieces, logs)[:, 0], list(_ways(words[k], pieces, max(map(len, pieces), default=1)))
        beta = np.full(len(alpha), -np.inf)
        beta[-1] = 0
        for start, end, p in reversed(ways):
            beta[start] = np.logaddexp(beta[start], logs[p, 0] + beta[end])
        for start, end, p in ways:
            out[p] += np.exp(alpha[start] + logs[p, 0] + beta[end] - alpha[-1]) * counts[k]
    return out


@dataclass
class LanguageModel:
    """Languages and their piece probabilities."""

    path: str
    languages: list[str]
    prob: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _word_counts(train: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, word, n over the letter runs of the texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                words = Counter(w for t in texts for w in _LETTERS.findall(t.lower()))
                if words:
                    yield pd.DataFrame({"lang": lang, "word": list(words), "n": np.array(list(words.values()), dtype=np.int64)})

    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> LanguageModel:
    """Piece probabilities from about ``train_docs`` of the labelled rows, in equal parts from all languages, chosen by a hash of the text.

    Rows that repeat a text and its language count once; null texts or languages are no examples. Of more than MOST_LANGUAGES languages
    those with the most rows are learned (ties by name), the others are no examples. An empty table gives a model without languages.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    seen = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()  # one row for each language
    sample = rows.where(F.lit(False))
    if seen:
        below = [(r.lang, draw_below(-(-train_docs // len(seen)), r.n)) for r in seen]
        shares = rows.sparkSession.createDataFrame(below, "lang string, below long")
        sample = rows.join(F.broadcast(shares), "lang").where(F.xxhash64("text") <= F.col("below")).select("text", "lang").dropDuplicates(["text", "lang"])
    words = cut(_word_counts(sample, "text", "lang"))
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())  # MOST_LANGUAGES at most
    pieces = piece_ids(path)
    size = len(pieces) + 1
    prob = np.full((size, max(1, len(languages))), 1 / size)
    for _ in range(rounds if languages else 0):
        sent = words.sparkSession.sparkContext.broadcast((languages, prob))

        def count(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, now = sent.value
            pieces = piece_ids(path)
            total = np.zeros_like(now)
            for batch in batches:
                for lang, rows in batch.groupby("lang"):
                    k = names.index(lang)
                    for start in range(0, len(rows), 20_000):
                        part = rows.iloc[start : start + 20_000]
                        total[:, k] += expected([START + w for w in part["word"]], part["n"].to_numpy(float), pieces, now[:, k])
            at, k = np.nonzero(total)
            yield pd.DataFrame({"lang": k.astype(np.int32), "piece": at.astype(np.int32), "n": total[at, k]})

        got = words.mapInPandas(count, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()  # languages x pieces at most
        counts = np.zeros_like(prob)
        counts[got["piece"], got["lang"]] = got["n"]
        counts[-1] = counts[-1].max()  # characters that the vocabulary lacks tell nothing
        prob = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * size)
        prob[-1] = prob[-1].min()
    return LanguageModel(path, languages, prob)


class _Scorer:
    """Scores of words met before, by the words' 64-bit hashes."""

    def __init__(self, model: LanguageModel):
        self.model, self.pieces = model, piece_ids(model.path)
        self.most = max(1000, min(REMEMBERED, REMEMBERED_BYTES // (8 * max(1, len(model.languages)))))
        self.clear()

    def clear(self) -> None:
        self.row: dict[int, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, dtype=bool)

    def learn(self, hashes: list[int], chunks: list[str]) -> None:
        runs = [_LETTERS.findall(c) for c in chunks]
        flat = [w for r in runs for w in r]
        words = {w: n for n, w in enumerate(dict.fromkeys(flat))}
        number = np.array([len(r) for r in runs], dtype=np.int64)
        of = np.repeat(np.arange(len(runs)), number)
        new = np.zeros((len(runs), len(self.model.languages)))
        if words:
            scores = forward([START + w for w in words], self.pieces, self.model.prob)[np.fromiter(map(words.__getitem__, flat), np.int64, len(flat))]
            new = np.stack([np.bincount(of, scores[:, k], len(runs)) for k in range(new.shape[1])], axis=1) if new.shape[1] else new
        self.row.update(zip(hashes, range(len(self.row), len(self.row) + len(hashes)), strict=True))
        end = len(self.row)
        if end > len(self.letters):  # grows by doubling
            more = end + len(self.letters)
            self.scores, self.letters = np.resize(self.scores, (more, self.scores.shape[1])), np.resize(self.letters, more)
        self.scores[end - len(hashes) : end], self.letters[end - len(hashes) : end] = new, number > 0

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and whether it has a letter."""
        if len(self.row) > self.most:
            self.clear()
        w = Words([t.lower().encode("utf-8", "surrogatepass") for t in texts])
        hashes, first, at = np.unique(w.hash, return_index=True, return_inverse=True)
        named = hashes.tolist()
        new = [n for n, h in enumerate(named) if h not in self.row]
        if new:
            places = zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)
            self.learn([named[n] for n in new], [w.data[a:b].decode("utf-8", "surrogatepass") for a, b in places])
        row = np.fromiter(map(self.row.__getitem__, named), np.int64, len(named))[at]
        logs = np.stack([np.bincount(w.text, self.scores[row, k], len(texts)) for k in range(len(self.model.languages))] or [np.zeros(0)], axis=1)
        has = np.bincount(w.text, self.letters[row], len(texts)) > 0
        return (logs if self.model.languages else np.zeros((len(texts), 0))), has


_scorers: dict[str, _Scorer] = {}


def _scorer(model: LanguageModel) -> _Scorer:
    """The worker's scorer of this model; those of earlier models go."""
    if model.key not in _scorers:
        _scorers.clear()
        _scorers[model.key] = _Scorer(model)
    return _scorers[model.key]


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score: the likeliest language of the whole text and its posterior probability (all languages alike before).

    ``und`` and 0 for null texts, texts without a letter (of Unicode's category L), and a model without languages. Columns of these names are
    replaced; others stay. Rows are scored on their own, so repeated ones alike; texts may have any length; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != text_col)]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        names = np.array([*sent.value.languages, UND], dtype=object)
        for batch in batches:
            texts = batch.column(text_col)
            for rows in by_block(np.asarray(pc.binary_length(texts.fill_null(""))), BLOCK_BYTES):
                size = rows.stop - rows.start
                logs, has = scorer.score([t or "" for t in texts.slice(rows.start, size).to_pylist()])
                if logs.shape[1]:
                    best = np.where(has, logs.argmax(axis=1), len(names) - 1)
                    score = np.where(has, 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                else:
                    best, score = np.zeros(size, dtype=int), np.zeros(size)
                columns = [*(batch.column(c).slice(rows.start, size) for c in kept), pa.array(names[best], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a row without an id isn't held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))
