"""Token counts by heap-and-linked-list byte-pair merging.

A text becomes a linked list of characters; the adjacent pair whose joined piece has the best rank is
popped from a heap and merged until no pair is left. The count is the number of initial symbols minus the
merges: no identifiers are made. The counts equal those of a BPE model of the sentencepiece library with its
defaults (a leading space mark, white space kept, byte fallback).

Pieces never contain a space mark after another character (checked when the model is read), so no merge
crosses from a word to the next space mark, and a text is the sum of its words. Their counts are memoised in a
bounded table; a model for which this does not hold is merged over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from quernstone.llm.common import id_and_text

MARK = "▁"
MEMO = 1_000_000


class Counts(dict):
    """word -> tokens; forgets all when full, so memory stays bounded.

    pieces: the model's pieces in order of rank; ties: their ranks, equal where the model's scores are.
    """

    def __init__(self, pieces: list[str], ties: list[int], most: int = MEMO) -> None:
        super().__init__()
        self.most, self.ties = most, ties
        at = {p: i for i, p in enumerate(pieces)}
        self.chars = {p: i for p, i in at.items() if len(p) == 1}
        self.pairs: dict[int, int] = {}
        for p, i in at.items():
            for cut in range(1, len(p)):
                left, right = at.get(p[:cut]), at.get(p[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = i
        self.first = {p: i for p, i in at.items() if len(p) == 2}
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        if any(c not in self.chars for p in pieces for c in p):
            raise ValueError("a piece has a character that is no piece of its own")

    def merged(self, word: str) -> int:
        """Initial symbols less merges. A character that is no piece stays alone, one token for each byte of it."""
        pairs, ties = self.pairs.get, self.ties
        symbols = list(map(self.chars.get, word, repeat(-1)))
        n = total = len(symbols)
        if -1 in symbols:
            total = sum(1 if s >= 0 else len(c.encode()) for s, c in zip(symbols, word, strict=True))
        best = list(map(self.first.get, map(add, word, word[1:]), repeat(-1)))  # what i and its next would become
        best.append(-1)
        heap = [ties[new] << 32 | i for i, new in enumerate(best) if new >= 0]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            new = best[i]
            if new < 0 or ties[new] != top >> 32:
                continue
            total -= 1
            symbols[i] = new
            j = after[i]
            best[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                up = best[i] = pairs(new << 32 | symbols[k], -1)
                if up >= 0:
                    heappush(heap, ties[up] << 32 | i)
            else:
                best[i] = -1
            h = before[i]
            if h >= 0:
                up = best[h] = pairs(symbols[h] << 32 | new, -1)
                if up >= 0:
                    heappush(heap, ties[up] << 32 | h)
        return total

    def __missing__(self, word: str) -> int:
        if self.inside.issuperset(map(add, word, word[1:])):
            n = self.merged(word)
        else:  # no piece has these two characters side by side
            cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside]
            n = sum(map(self.__getitem__, map(word.__getitem__, map(slice, [0, *cuts], [*cuts, len(word)]))))
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


class PieceCounter:
    """Counts tokens as a sentencepiece BPE model does."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not model.trainer_spec.byte_fallback or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("a BPE model with identity normalisation and byte fallback is needed")
        normal = sorted((p for p in model.pieces if p.type == 1), key=lambda p: -p.score)
        ties: list[int] = []
        for i, p in enumerate(normal):
            ties.append(ties[-1] if i and p.score == normal[i - 1].score else i)
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.words = Counts([p.piece for p in normal], ties)
        self.splits = not any(MARK in p.piece.lstrip(MARK) for p in normal)
        self.chunk = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = self.prefix + text.replace(" ", MARK)
        if not self.splits or "\n" in self.words.chars:
            return self.words.merged(marked)
        return sum(map(self.words.__getitem__, self.chunk.findall(marked)))


_counters: dict[str, PieceCounter] = {}


def counter(model_file: str) -> PieceCounter:
    """One counter for a worker process."""
    if model_file not in _counters:
        _counters[model_file] = PieceCounter(model_file)
    return _counters[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no bytes and no tokens. Repeated rows each give a row; an empty table gives none.
    The model file must be at the same path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file)
        for batch in batches:
            ids, sizes, counts = batch.column(0), [], []
            for scalar in batch.column(1):
                text = scalar.as_py()
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                counts.append(c.count(text))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
