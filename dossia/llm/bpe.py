"""BPE encoding and decoding of text columns with a pair occurrence index.

For the words of a block of texts that haven't been met before, every adjacent pair of symbols is mapped to all its positions.
The ranks of the pairs that occur are active; they are applied in ascending order, each at all its positions, and the lists of
the pairs that a merge makes are extended. Words don't touch each other, so all words of the block are merged in one pass.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that a task encodes at once, and chunks of text whose ids a worker remembers.
BLOCK_BYTES = 3_000_000
REMEMBERED = 200_000

# str.split() also splits at these, which the tokenizer's \s doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_NOT_SPACE = regex.compile(r"[^\p{White_Space}]+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class PairIndexBpe:
    """A vocabulary with word ends, read from a tokenizer file, and the ids of the chunks of text met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end, chars = model.get("end_of_word_suffix") or "", byte_chars()
        self.inner, self.last = (np.array([vocab[c + e] for c in chars], dtype=np.int32) for e in ("", end))
        self.width = max(vocab.values()) + 1
        self.pair: list[int] = []  # by rank
        self.made: list[int] = []
        born: dict[str, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if max(born.get(a, -1), born.get(b, -1)) >= r or (a + b) in born:
                raise ValueError("a merge comes before its parts: ranks can't be applied in ascending order")
            born[a + b] = r
            self.pair.append(vocab[a] * self.width + vocab[b])
            self.made.append(vocab[a + b])
        self.rank_of_sorted = np.argsort(self.pair).astype(np.int32)
        self.sorted_pairs = np.array(self.pair, dtype=np.int64)[self.rank_of_sorted]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_ids = set(self.special.values())
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(split["pattern"]["Regex"] + "|\n").findall
        self.known: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 if it never merges."""
        key = left.astype(np.int64) * self.width + right
        near = np.searchsorted(self.sorted_pairs, key)
        near[near == len(self.sorted_pairs)] = 0
        return np.where(self.sorted_pairs[near] == key, self.rank_of_sorted[near], -1)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all (not empty) words, one after another, and how many each word has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        last = np.cumsum(size) - 1
        sym = self.inner[raw]
        sym[last] = self.last[raw[last]]
        n = len(sym)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[last], prv[last[:-1] + 1], prv[0] = -1, -1, -1

        at: dict[int, list[np.ndarray]] = {}  # rank of a pair: all its positions
        active: list[int] = []

        def note(ranks: np.ndarray, positions: np.ndarray) -> None:
            found = ranks >= 0
            if not found.any():
                return
            ranks, positions = ranks[found], positions[found]
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
                if r in at:
                    at[r].append(part)
                else:
                    at[r] = [part]
                    heapq.heappush(active, r)

        first = np.flatnonzero(nxt >= 0)
        note(self._ranks(sym[first], sym[first + 1]), first.astype(np.int32))
        while active:
            r = heapq.heappop(active)
            a, b = divmod(self.pair[r], self.width)
            new, parts = self.made[r], at.pop(r)
            i = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            i = i[(sym[i] == a) & (nxt[i] >= 0)]
            i = i[sym[nxt[i]] == b]  # earlier merges have taken the others
            if a == b and len(i) > 1:  # overlapping pairs are merged from the left
                taken, free = set(), []
                for x in np.sort(i).tolist():
                    if x not in taken:
                        free.append(x)
                        taken.add(int(nxt[x]))
                i = np.array(free, dtype=np.int32)
            if not len(i):
                continue
            j = nxt[i]
            k, p = nxt[j], prv[i]
            sym[i], sym[j], nxt[i] = new, -1, k
            after, before = k >= 0, p >= 0
            ik, k, ip, p = i[after], k[after], p[before], p[before]
            prv[k] = ik
            left, right = np.concatenate([sym[ik], sym[p]]), np.concatenate([sym[k], np.full(len(p), new, sym.dtype)])
            note(self._ranks(left, right), np.concatenate([ik, ip]))
        stays = sym >= 0
        return sym[stays], np.add.reduceat(stays, last - size + 1, dtype=np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Remembers the ids of chunks of text without white space."""
        if not chunks:
            return
        normal = unicodedata.normalize("NFC", "\n".join(chunks))
        # Character by character: a capital sigma at a word's end becomes the usual small one.
        normal = normal.lower() if "Σ" not in normal else "".join(x.lower() for x in normal)
        words = self.words_of(normal)
        number: dict[str, int] = {}
        which = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        line = number.get("\n", -1)
        distinct = [w.encode("utf-8", "surrogatepass") for w in number]
        ids, count = self.merge_words(distinct)
        ends = np.cumsum(count)
        of_chunk = np.cumsum(which == line)[which != line]
        which = which[which != line]
        each = count[which]
        # The ids of all words in turn: from each word's first id on.
        take = np.repeat(ends[which] - each, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        packed = ids[take].astype("<i4").tobytes()
        to = (np.cumsum(np.bincount(of_chunk, weights=each, minlength=len(chunks)).astype(np.int64)) * 4).tolist()
        start = 0
        for c, end in zip(chunks, to, strict=True):
            self.known[c] = packed[start:end]
            start = end

    def chunks(self, text: str) -> list[str]:
        return text.split() if not _SEPARATORS.search(text) else _NOT_SPACE.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        pieces: list[list] = []
        for t in texts:
            if self.cut is not None and self.cut.search(t):
                parts = self.cut.split(t)
                pieces.append([c if k % 2 == 0 else self.special[p] for k, p in enumerate(parts) for c in (self.chunks(p) if k % 2 == 0 else [p])])
            else:
                pieces.append(self.chunks(t))
        new = {c for p in pieces for c in p if c not in self.known}
        specials = {c for c in new if isinstance(c, int)}
        self.learn(list(new - specials))
        self.known.update({c: np.array([c], dtype="<i4").tobytes() for c in specials})
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def decode(self, ids: list[int], skip_special: bool) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder does; unknown ids are left out."""
        tokens = self.tokens
        if skip_special:
            ids = [i for i in ids if i not in self.special_ids]
        try:
            return " ".join(map(tokens.__getitem__, ids))
        except KeyError:
            return " ".join(tokens[i] for i in ids if i in tokens)


@functools.lru_cache(4)
def model(path: str) -> PairIndexBpe:
    """One for each worker and path."""
    return PairIndexBpe(path)


def by_block(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows of about ``most`` bytes."""
    start, total = 0, 0
    for k, s in enumerate(sizes):
        total += int(s)
        if total >= most:
            yield slice(start, k + 1)
            start, total = k + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def _with_column(df: DataFrame, drop: str | None, name: str, kind: T.DataType, compute) -> DataFrame:
    """df with a column that ``compute(array) -> array`` gives, batch by batch."""
    kept = [c for c in df.columns if c not in (name, drop)]
    schema = T.StructType([*(f for f in df.schema.fields if f.name in kept), T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(c) for c in kept]
            for rows, column in compute(batch):
                yield pa.RecordBatch.from_arrays([*(c.slice(rows.start, rows.stop - rows.start) for c in rest), column], names=[*kept, name])

    return df.mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids", keep_text: bool = True) -> DataFrame:
    """docs with ``out_col``: the ids (array<int>) of each whole text, without special tokens added.

    ``path``: a tokenizer file with BPE merges. Strings of its special tokens in a text become their ids, as the tokenizers library
    does. Null and empty texts have no ids. A column of that name is replaced; the others stay. No row depends on another.
    """

    def compute(batch: pa.RecordBatch):
        bpe, column = model(path), batch.column(text_col)
        sizes = np.asarray(pc.binary_length(column.fill_null("")))
        for rows in by_block(sizes, BLOCK_BYTES):
            packed = bpe.encode([t or "" for t in column.slice(rows.start, rows.stop - rows.start).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            yield rows, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))

    return _with_column(docs, None if keep_text else text_col, out_col, T.ArrayType(T.IntegerType()), compute)


def bpe_decode(tokens: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded", skip_special: bool = False) -> DataFrame:
    """tokens with ``out_col``: the text of each row's ids as the tokenizers library decodes them; null counts as no ids.

    Null ids in an array and ids that the vocabulary lacks are left out.
    """

    def compute(batch: pa.RecordBatch):
        bpe, column = model(path), batch.column(ids_col)
        sizes = np.asarray(pc.list_value_length(column).fill_null(0)) * 8
        for rows in by_block(sizes, BLOCK_BYTES):
            lists = column.slice(rows.start, rows.stop - rows.start).to_pylist()
            yield rows, pa.array([bpe.decode(x or [], skip_special) for x in lists], pa.string())

    return _with_column(tokens, None, out_col, T.StringType(), compute)
