"""Alignment of the tokens that two tokenizers give the same text, by a dangling-suffix transducer.

A state is the side that leads and its bytes that the other side hasn't matched yet (the residual). The next token comes from the side behind; it eats from
the residual or takes the lead itself. Transitions are memoised by residual and token. When the residual is empty a group closes:
both sides have a token that ends there. The last tokens of a group are linked.

The shorter of two linked tokens is a suffix of the longer one, so the pairs that can be linked are known from the vocabularies alone, some
300,000 of them. Links are held as numbers of such pairs, and counts of all pairs are a table of a fixed size whatever the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossia.llm import packing
from dossia.llm.bpe import by_block
from dossia.llm.common import stored

BLOCK_BYTES = 2_000_000
#: Results of chunks of up to so many characters, and transitions, that a worker remembers.
CHUNK_CHARS = 64
REMEMBERED = 150_000
TRANSITIONS = 300_000

# Both tokenizers cut a text before spaces that follow a character other than white space. Spaces at the end stay with the last chunk.
_CUT = re.compile(r"(?<=\S)(?= +[^ ])")

A, B = 0, 1
_EMPTY = 0  # the state without a residual

#: What a chunk gives: numbers of tokens of both sides and of groups, the groups as text, and the packed numbers of its links; None if the sides don't agree.
Aligned = tuple[int, int, int, bytes, bytes] | None


class Aligner:
    """A byte-level BPE (side A, of a space and the text) and a sentencepiece model (side B, which adds the space itself)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = packing.model(a_path).bpe
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        specials = self.a.special_tokens_set
        self.bytes_of: list[list[bytes | None]] = [self._a_bytes(specials), [self._b_bytes(i) for i in range(self.b.get_piece_size())]]
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)  # no piece runs across a word's start
        self.text_of = [[str(i) for i in range(len(tokens))] for tokens in self.bytes_of]
        self.known: dict[str, Aligned] = {}
        self.old: dict[str, Aligned] = {}
        self._forget()
        self.pairs = possible_pairs(*self.bytes_of)

    def _a_bytes(self, specials: set[str]) -> list[bytes | None]:
        out: list[bytes | None] = [None] * self.a.n_vocab
        special_ids = {self.a.encode_single_token(s) for s in specials}
        for i in range(self.a.n_vocab):
            if i not in special_ids:
                try:
                    out[i] = self.a.decode_single_token_bytes(i)
                except KeyError:  # a gap in the numbers
                    continue
        return out

    def _b_bytes(self, i: int) -> bytes | None:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return None
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def _forget(self) -> None:
        self.states: list[tuple[int, bytes]] = [(A, b"")]
        self.lead = [A]
        self.number: dict[tuple[int, bytes], int] = {(A, b""): _EMPTY}
        self.memo: dict[tuple[int, int], int] = {}

    def step(self, state: int, token: int) -> int:
        """The state after the next token of the side that is behind (A where none is), or -1 if its bytes don't fit the residual."""
        after = self.memo.get((state, token))
        if after is None:
            lead, residual = self.states[state]
            side = B if residual and lead == A else A
            new = self.bytes_of[side][token]
            if not new:
                to = None
            elif residual.startswith(new):
                to = (lead, residual[len(new) :])
            elif new.startswith(residual):
                to = (side, new[len(residual) :])
            else:
                to = None
            to = to if to is None or to[1] else (A, b"")
            after = -1
            if to is not None:
                after = self.number.setdefault(to, len(self.states))
                if after == len(self.states):
                    self.states.append(to)
                    self.lead.append(to[0])
            self.memo[state, token] = after
        return after

    def groups(self, a_ids: list[int], b_ids: list[int]) -> list[tuple[int, int]] | None:
        """Where each group ends in both lists: between places where both sides have a token's end. None if the sides' bytes differ."""
        ends, i, j, state = [], 0, 0, _EMPTY
        lead, memo = self.lead, self.memo
        try:
            while i < len(a_ids) or j < len(b_ids) or state:
                if state and lead[state] == A:
                    key = state, b_ids[j]
                    j += 1
                else:
                    key = state, a_ids[i]
                    i += 1
                state = memo[key] if key in memo else self.step(*key)
                if state <= _EMPTY:
                    if state < _EMPTY:
                        return None
                    ends.append((i, j))
        except IndexError:  # one side has ended before the other
            return None
        return ends

    def learn(self, chunks: list[str]) -> None:
        if len(self.memo) > TRANSITIONS:
            self._forget()
        encode, a_text, b_text = self.a.encode_ordinary, self.text_of[A], self.text_of[B]
        results, keys, where = [], [], []
        for chunk, b_ids in zip(chunks, self.b.encode([c[1:] for c in chunks], num_threads=1), strict=True):
            a_ids = encode(chunk)
            ends = self.groups(a_ids, b_ids)
            if ends is None:
                results.append(None)
            else:
                at, bt, told, from_a, from_b = [a_text[i] for i in a_ids], [b_text[i] for i in b_ids], [], 0, 0
                for i, j in ends:
                    told.append(",".join(at[from_a:i]) + "|" + ",".join(bt[from_b:j]))
                    keys.append(a_ids[i - 1] << 32 | b_ids[j - 1])
                    from_a, from_b = i, j
                results.append((len(a_ids), len(b_ids), len(ends), ";".join(told).encode()))
            where.append(len(keys))
        numbers, start = np.searchsorted(self.pairs, np.array(keys, dtype=np.int64)).astype("<i4").tobytes(), 0
        for chunk, result, end in zip(chunks, results, where, strict=True):
            self.known[chunk] = result and (*result, numbers[4 * start : 4 * end])
            start = end

    def align(self, texts: list[str]) -> Iterator[Aligned]:
        """What each text gives; None for empty ones and those whose bytes either side doesn't keep."""
        if len(self.known) > REMEMBERED:  # chunks met again since move on, the others are forgotten
            self.old, self.known = self.known, {}
        cut = [(_CUT.split(" " + t) if self.cuts else [" " + t]) if t else [] for t in texts]
        new = {c for chunks in cut for c in chunks if c not in self.known}
        self.known.update((c, self.old[c]) for c in new if c in self.old)
        self.learn(sorted(c for c in new if c not in self.old))
        get = self.known.__getitem__
        for chunks in cut:
            parts = list(map(get, chunks))
            if not parts or None in parts:
                yield None
            elif len(parts) == 1:
                yield parts[0]
            else:
                a, b, groups, text, links = zip(*parts, strict=True)
                yield sum(a), sum(b), sum(groups), b";".join(text), b"".join(links)
        for c in new:
            if len(c) > CHUNK_CHARS:
                del self.known[c]


def possible_pairs(a: list[bytes | None], b: list[bytes | None]) -> np.ndarray:
    """Sorted keys (A id << 32 | B id) of all pairs of which one token's bytes end with the other's."""
    by_bytes: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
    for side, tokens in ((A, a), (B, b)):
        for i, t in enumerate(tokens):
            if t:
                by_bytes[side][t].append(i)
    keys = [i << 32 | j for i, t in enumerate(a) if t for k in range(len(t)) for j in by_bytes[B].get(t[k:], ())]
    keys += [i << 32 | j for j, t in enumerate(b) if t for k in range(1, len(t)) for i in by_bytes[A].get(t[k:], ())]
    return np.array(sorted(keys), dtype=np.int64)


@functools.lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker and pair of files."""
    return Aligner(a_path, b_path)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, groups_sha256, links for each row of docs.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3`` (left out without ``keep_groups``); groups_sha256 is its digest in hex. ``links`` are packed little-endian 32-bit numbers of
    possible_pairs, one for each group. Strings of special tokens are plain text. Null and empty texts, and those
    of which a side doesn't keep all bytes, have no tokens: zeros, and empty strings. Texts of any length are taken whole; rows don't depend on each other, so repeated ones give the
    same; an empty table gives an empty result. Other columns of docs are not read.
    """
    kind = docs.select(F.col(id_col).alias("doc_id")).schema[0].dataType
    long, text = T.LongType(), T.StringType()
    fields = [("doc_id", kind), ("n_a", long), ("n_b", long), ("n_groups", long), *([("groups", text)] if keep_groups else []), ("groups_sha256", text), ("links", T.BinaryType())]
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = aligner(a_path, b_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for rows in by_block(np.asarray(pc.binary_length(texts.fill_null(""))), BLOCK_BYTES):
                size = rows.stop - rows.start
                found = [x or (0, 0, 0, b"", b"") for x in sides.align([t or "" for t in texts.slice(rows.start, size).to_pylist()])]
                a, b, groups, told, links = zip(*found, strict=True)
                digest = [hashlib.sha256(t).hexdigest() if t else "" for t in told]
                told = [pa.array([t.decode() for t in told], pa.string())] if keep_groups else []
                numbers = (pa.array(x, pa.int64()) for x in (a, b, groups))
                yield pa.RecordBatch.from_arrays([ids.slice(rows.start, size), *numbers, *told, pa.array(digest), pa.array(links, pa.binary())], names=names)

    schema = T.StructType([T.StructField(n, k) for n, k in fields])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _links(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch, and where each row's end."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(r or b"" for r in rows), dtype="<i4"), np.cumsum([len(r or b"") // 4 for r in rows], dtype=np.int64)


def pair_counts(aligned: DataFrame, pairs: int) -> np.ndarray:
    """How many links of the whole corpus hold each of the ``pairs`` possible pairs. Tasks send, and the driver gets, at most so many sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pairs, dtype=np.int64)
        for batch in batches:
            links, _ = _links(batch.column(0))
            if len(links):
                total += np.bincount(links, minlength=pairs)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    got = aligned.select("links").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(pairs, dtype=np.int64)
    counts[got["pair"].to_numpy(dtype=np.int64)] = got["n"]
    return counts


def best_of_b(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of all pairs of its B id; ties are all the highest."""
    b = pairs & 0xFFFFFFFF
    most = np.zeros(int(b.max(initial=0)) + 1, dtype=np.int64)
    np.maximum.at(most, b, counts)
    return (counts > 0) & (counts == most[b])


def scored(aligned: DataFrame, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """aligned with n_links, n_best (links whose pair is one of the best of its B id) and count_sum (over links) instead of links."""
    sent = aligned.sparkSession.sparkContext.broadcast((counts, best))  # of the vocabularies' size
    kept = [c for c in aligned.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_pair, is_best = sent.value
        for batch in batches:
            links, ends = _links(batch.column("links"))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (is_best[links].astype(np.int64), of_pair[links])]
            new = [ends - starts, *(s[ends] - s[starts] for s in sums)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x) for x in new)], names=[*kept, "n_links", "n_best", "count_sum"])

    schema = T.StructType([aligned.schema[c] for c in kept])
    for c in ("n_links", "n_best", "count_sum"):
        schema = schema.add(c, T.LongType())
    return aligned.mapInArrow(run, schema)


def aligned_scores(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """align_tokens with n_links, n_best and count_sum, counted over all of docs. Texts are tokenised once: their links are written and read twice."""
    aligned = stored(align_tokens(docs, a_path, b_path, id_col, text_col, keep_groups), "aligned")
    pairs = aligner(a_path, b_path).pairs
    counts = pair_counts(aligned, len(pairs))
    return scored(aligned, counts, best_of_b(pairs, counts))
