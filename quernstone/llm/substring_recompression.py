"""Repeated word windows by recompression.

A document's words are symbols. Each round replaces runs of one symbol by a symbol for run and length, then pairs
of a left and a right symbol by a symbol for the pair; which side a symbol is on is a bit of its name, drawn anew
each round. A name is a hash of what it stands for, so all tasks of the Spark job name alike what is alike,
and equal substrings get equal symbols but for some at their ends. With each symbol goes the stretch of words that
decided it: a symbol whose stretch lies inside a window is the same in every copy of that window. A window's owner
is a symbol of the last round inside it, the one whose name hashes highest; owners that several windows share reveal repeats, which are then
verified word for word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import apart, id_and_text
from quernstone.llm.repeats import chunks, distinct_texts, powers, removed, repeated_spans, with_part

WIDTH = 20
ROUNDS = 4
#: Bytes whose words are named at a time.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_white = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_codes = mix(np.arange(1, 257, dtype=np.uint64))
_base = 0x9E3779B97F4A7C15
_inverse = pow(_base, -1, 1 << 64)


def word_edges(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, a line feed after each, where words start and end in them, and how many each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    white = _white[data]
    start = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    end = np.flatnonzero(white & np.concatenate(([False], ~white[:-1])))
    ends = np.searchsorted(start, np.cumsum([len(x) + 1 for x in texts]))
    return data, start, end, np.diff(np.concatenate(([0], ends)))


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_codes[data] * powers(_base, len(data)))))
    names = (sums[end] - sums[start]) * powers(_inverse, len(data))[start]
    return mix(names ^ (end - start).astype(np.uint64))


def symbols(names: np.ndarray, rounds: int, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each round the names, and the first and last place of the words that decided each.

    Runs are replaced in the first round, by words; a word beside them was decided by knowing that they differ from
    it, which every symbol's stretch takes in. Later rounds leave equal neighbours apart: they are on one side.
    """
    n = len(names)
    same = np.concatenate(([False], names[1:] == names[:-1]))
    head = np.flatnonzero(~same)
    size = np.diff(np.append(head, n))
    names = np.where(size > 1, mix(names[head] * np.uint64(31) + size.astype(np.uint64)), names[head])
    lo, hi = head - 1, head + size
    out = [(names, lo, hi)]
    for k in range(1, rounds + 1):
        side = (mix(names + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
        joined = np.flatnonzero(~side[:-1] & side[1:])
        goes = np.zeros(len(names), dtype=bool)
        goes[joined + 1] = True
        # a symbol that stays alone was decided by the neighbour on the side it could have joined
        new_lo, new_hi, new = lo.copy(), hi.copy(), names.copy()
        new_lo[1:] = np.where(side[1:], np.minimum(lo[1:], lo[:-1]), lo[1:])
        new_hi[:-1] = np.where(side[:-1], hi[:-1], np.maximum(hi[:-1], hi[1:]))
        new[joined] = mix(names[joined] * np.uint64(0xD6E8FEB86659FD93) + mix(names[joined + 1]) + np.uint64(k))
        new_lo[joined], new_hi[joined] = np.minimum(lo[joined], lo[joined + 1]), np.maximum(hi[joined], hi[joined + 1])
        kept = ~goes
        names, lo, hi = new[kept], new_lo[kept], new_hi[kept]
        out.append((names, lo, hi))
    return out


class WordCutter:
    """Windows of `width` words, parted at ASCII white space; the first of equal windows stays."""

    first_stays = True
    hot = 1 << 20  # some 7 MB of text, 100 MB as arrays of words and windows

    def __init__(self, width: int = WIDTH, rounds: int = ROUNDS) -> None:
        self.width, self.rounds, self.least = width, rounds, 2 * width - 1

    def runs(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        data, begin, end, counts = word_edges(texts)
        hashes = word_names(data, begin, end)
        # what stands for a text's end is in no window
        names = np.insert(hashes, np.cumsum(counts), mix(np.arange(len(texts), dtype=np.uint64) + np.uint64(1 << 40)))
        bounds = np.concatenate(([0], np.cumsum(counts + 1)))
        m = len(names) - self.width + 1
        valid = np.ones(max(0, m), dtype=bool)
        near = np.zeros(len(names) + 1, dtype=np.int64)
        np.add.at(near, np.maximum(0, bounds[1:] - self.width), 1)
        np.add.at(near, bounds[1:], -1)
        valid &= np.cumsum(near)[: len(valid)] == 0
        if not valid.any():
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)
        owner, twice = np.zeros(m, np.uint64), [np.zeros(0, np.uint64)]
        levels = symbols(names, self.rounds, self.width)
        for k in range(self.rounds, -1, -1):
            symbol, lo, hi = levels[k]
            ok = (hi - lo < self.width) & (lo >= 0) & (hi < len(names))
            if k == 0:  # the window of a few long runs: any word in it, by its own name
                symbol, lo, hi, ok = names, np.arange(len(names)), np.arange(len(names)), slice(None)
            value = mix(symbol[ok]) | np.uint64(1)
            first, last = np.maximum(0, hi[ok] - self.width + 1), np.minimum(lo[ok], m - 1)
            best = range_max(value, first, last - first + 1, m)
            owner = np.where(owner == 0, best, owner)
            ordered = np.sort(value)
            twice.append(ordered[1:][ordered[1:] == ordered[:-1]])
            if owner[valid].all():
                break
        edge = np.ones(m, dtype=bool)
        edge[1:] = (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
        start = np.flatnonzero(edge)
        n = np.diff(np.append(start, m))
        start, n = start[valid[start]], n[valid[start]]
        which = np.searchsorted(bounds, start, side="right") - 1
        return which, start - bounds[which], n, owner[start].view(np.int64), np.isin(owner[start], np.concatenate(twice))

    def parts(self, text: bytes, most: int) -> list[tuple[int, bytes]]:
        words = text.split()
        step = max(1, most // 8)
        return [(a, b" ".join(words[a : a + step + self.width - 1])) for a in range(0, max(1, len(words) - self.width + 1), step)]

    def windows(self, text: bytes, start: int, n: int) -> list[bytes]:
        words = text.split()
        return [b" ".join(words[i : i + self.width]) for i in range(start, start + n)]

    def pieces(self, text: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
        words = text.split()
        return [b" ".join(words[start : start + n + self.width - 1]) for start, n in runs]

    def repeated(self, group: np.ndarray, pieces: list[bytes], n: np.ndarray) -> np.ndarray:
        """The first window of its content, in the order of document and start, is the one that stays.

        Windows that hash alike are compared with the first of them, byte for byte, a stretch of neighbours at a time.
        """
        first: dict[tuple[int, bytes], int] = {}
        met = np.array([first.setdefault(x, i) != i for i, x in enumerate(zip(group.tolist(), pieces, strict=True))])  # all its windows were
        out = np.repeat(met, n)
        which = np.flatnonzero(~met)
        out[~out] = self._later(group[which], [pieces[i] for i in which.tolist()], n[which])
        return out

    def _later(self, group: np.ndarray, pieces: list[bytes], n: np.ndarray) -> np.ndarray:
        names, begins, ends = [], [], []
        for some in chunks(pieces, CHUNK):
            data, begin, end, counts = word_edges(some)
            offset = np.repeat(np.cumsum([0, *(len(x) + 1 for x in some[:-1])]), counts)
            names.append(word_names(data, begin, end))
            begins.append((begin - offset).astype(np.int32))
            ends.append((end - offset).astype(np.int32))
        begin, end = np.concatenate(begins), np.concatenate(ends)
        words = sum(map(len, names))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.concatenate(names) * powers(_base, words))))
        piece = np.repeat(np.arange(len(n), dtype=np.int32), n)
        at = np.arange(len(piece)) + piece * (self.width - 1)  # its first word
        h = mix((sums[at + self.width] - sums[at]) * powers(_inverse, words)[at]) + mix(group.astype(np.uint64))[piece]
        order = np.argsort(h, kind="stable")
        fresh = np.concatenate(([True], h[order][1:] != h[order][:-1]))
        head = np.empty(len(h), dtype=np.int64)
        head[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        flags = head != np.arange(len(h))
        k = np.flatnonzero(flags)
        edge = np.ones(len(k) + 1, dtype=bool)
        edge[1:-1] = (np.diff(k) != 1) | (np.diff(head[k]) != 1) | (np.diff(piece[k]) != 0) | (np.diff(piece[head[k]]) != 0)
        edges = np.flatnonzero(edge)
        for i, j in zip(k[edges[:-1]].tolist(), k[edges[1:] - 1].tolist(), strict=True):
            x, y = ((piece[w], begin[at[w]], end[at[w] + j - i + self.width - 1]) for w in (i, int(head[i])))
            if pieces[x[0]][x[1] : x[2]] != pieces[y[0]][y[1] : y[2]]:  # different windows of one hash: told apart by content
                for value in set(h[i : j + 1].tolist()):
                    seen: set[tuple[int, bytes]] = set()
                    for w in np.flatnonzero(h == value).tolist():
                        window = int(group[piece[w]]), pieces[piece[w]][begin[at[w]] : end[at[w] + self.width - 1]]
                        flags[w] = window in seen
                        seen.add(window)
        return flags


def range_max(value: np.ndarray, first: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the largest value of the ranges that hold it, or zero."""
    some = size > 0
    value, first, size = value[some], first[some], size[some]
    above = np.zeros(n, dtype=np.uint64)
    if not len(value):
        return above
    level = np.frexp(size.astype(float))[1] - 1
    for k in range(int(level.max()), -1, -1):
        here = above
        at = np.flatnonzero(level == k)
        np.maximum.at(here, first[at], value[at])
        np.maximum.at(here, first[at] + size[at] - (1 << k), value[at])
        if k:
            half = 1 << (k - 1)
            above = here.copy()
            np.maximum(above[half:], here[: n - half], out=above[half:])
    return above


def remove_repeats(docs: DataFrame, path: str, width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept, part for each row of docs (doc_id, text).

    A word goes if a window of `width` words covers it whose words also start earlier: in a smaller doc_id, or
    before it in the same document. Windows are judged on the input. kept: the words left, one space between (null
    unless keep_text). Null and empty texts have no words. Rows with equal doc_id and text are one document, which
    each of them stands for; different texts of one doc_id are documents of their own, in the order of a hash of the
    text (31 bits). Rows with a null doc_id lose nothing and no other row loses anything to them. An empty table gives none.
    """
    base = with_part(id_and_text(docs))
    cutter = WordCutter(width)
    texts, notes = distinct_texts(base, cutter.least, path)
    found = repeated_spans(texts, cutter, path)
    copies = notes.filter("doc_id <> rep_id or part <> rep_part").select("doc_id", "part", F.lit(True).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                words = [x.as_py().encode().split() for x in some.column(1)]
                sizes, gone_, kept_ = [len(w) for w in words], [], []
                for w, gone, copy in zip(words, removed(some.column(2), sizes, width), some.column(3).to_pylist(), strict=True):
                    if copy:
                        gone = np.full(len(w), len(w) >= width)
                    gone_.append(int(np.count_nonzero(gone)))
                    kept_.append(b" ".join(compress(w, (~gone).tolist()) if gone_[-1] else w))
                digests = [hashlib.sha256(x).hexdigest() for x in kept_]
                texts_ = [x.decode() for x in kept_] if keep_text else [None] * len(words)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int64()), pa.array(gone_, pa.int64()), pa.array(digests), pa.array(texts_, pa.string()), some.column(4)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "part"])

    key = ["doc_id", "part"]
    whole, rest = apart(base, found.select(*key).unionByName(copies.select(*key)), key)
    rest = rest.join(found, key, "left").join(copies, key, "left").select("doc_id", "text", "spans", "copy", "part")
    marked = whole.select("doc_id", "text", F.lit(None).cast(found.schema["spans"].dataType).alias("spans"), F.lit(None).cast("boolean").alias("copy"), "part").unionByName(rest)
    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, part int")
