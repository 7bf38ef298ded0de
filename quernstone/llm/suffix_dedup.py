"""Repeated byte strings by prefix-free parsing.

Stage one samples, in each window, the place whose rolling hash is least; equal windows sample the same string, and
windows whose sampled string occurs once cannot repeat. What is left are pieces of text that repeat heavily, dealt
out by their sampled string so that equal windows meet.

Stage two sorts them. Rolling-hash triggers cut the pieces into phrases, each from one trigger to the end of the
next, so no phrase's tail is the start of another's. The distinct phrases are the dictionary and the pieces,
written in phrases, are the parse. The suffix array of the dictionary orders the tails of phrases, that of the
parse orders what follows a phrase, and both together give the order of all suffixes of the pieces. In it, equal
windows are neighbours; neighbours are compared byte for byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import id_and_text
from quernstone.llm.repeats import distinct_texts, powers, removed, repeated_spans, spans, with_part

WIDTH = 200
SAMPLED = 32
TRIGGER = 8
PHRASE = 24
_bases = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def rolling(data: np.ndarray, width: int, base: int = _bases[0]) -> np.ndarray:
    """A 64-bit hash of each stretch of `width` bytes, from the hashes of its halves."""
    size, have = 1, (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out, done = None, 0
    while True:
        if width & size:
            if out is None:
                out, done = have, size
            else:
                m = min(len(have), len(out) - size) if len(out) > size else 0
                out = have[:m] * np.uint64(pow(base, done, 1 << 64)) + out[size : size + m]
                out = out ^ (out >> np.uint64(31))
                done += size
        size *= 2
        if size > width:
            break
        half = size // 2
        have = have[: max(0, len(have) - half)] * np.uint64(pow(base, half, 1 << 64)) + have[half:]
        have ^= have >> np.uint64(29)
    n = len(data) - width + 1
    return out[: max(0, n)]


def sliding_least(value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each stretch of `width` values, and its leftmost place."""
    low, at, size = value, np.arange(len(value), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        right = low[step:] < low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    return low, at


def _starts(ordered: np.ndarray) -> np.ndarray:
    """For each entry of a sorted array where its equals begin."""
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def suffix_ranks(first: np.ndarray, left: np.ndarray, depth: int = 1) -> np.ndarray:
    """Ranks of all suffixes of many strings by prefix doubling; equal suffixes have equal ranks.

    first: a number for the first `depth` symbols from each place, in their order; left: how many symbols the place's
    string still has. A rank counts from 1 and is one more than the number of smaller suffixes, so a round only
    has to order anew the places that still share a rank and have symbols left.
    """
    n = len(first)
    order = np.argsort(first)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = _starts(first[order]) + 1
    k, some = depth, np.arange(n)
    while len(some):
        shared = np.bincount(rank[some], minlength=n + 1)
        open_ = np.bincount(rank[some[left[some] > k]], minlength=n + 1)
        some = some[(shared[rank[some]] > 1) & (open_[rank[some]] > 0)]
        if not len(some):
            break
        longer = left[some] > k
        key = rank[some] * np.int64(n + 1)
        key[longer] += rank[some[longer] + k]
        order = np.argsort(key)
        some, key = some[order], key[order]
        old = rank[some]
        rank[some] = old + _starts(key) - _starts(old)
        k *= 2
    return rank


def leading(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first seven bytes from each place, none beyond its string's end, as a number in their order."""
    out = np.zeros(len(data), dtype=np.int64)
    for j in range(7):
        symbol = np.zeros(len(data), dtype=np.int64)
        symbol[: len(data) - j] = data[j:].astype(np.int64) + 1
        out = (out << 9) | np.where(left > j, symbol, 0)
    return out


def repeated_windows(pieces: list[bytes], sizes: np.ndarray, width: int, times: np.ndarray) -> np.ndarray:
    """For different pieces, each with its number of windows and of occurrences: which windows repeat, in a row."""
    total = int(sizes.sum())
    data = np.frombuffer(b"".join(pieces) + bytes(8), dtype=np.uint8)
    lengths = np.array([len(p) for p in pieces])
    ends = np.cumsum(lengths)
    begins = ends - lengths
    n = int(ends[-1])
    # phrases: from a trigger, or a piece's start, to the end of the next trigger, or the piece's end
    piece_of = np.repeat(np.arange(len(pieces)), lengths)
    trigger = np.zeros(n, dtype=bool)
    hashes = rolling(data[:n], TRIGGER)
    trigger[: len(hashes)] = (hashes >> np.uint64(20)) % np.uint64(PHRASE) == 0
    trigger &= np.arange(n) + TRIGGER <= ends[piece_of]
    starts_here = trigger.copy()
    starts_here[begins] = True
    start = np.flatnonzero(starts_here)
    following = np.append(start[1:], n)
    same = np.append(piece_of[start[1:]] == piece_of[start[:-1]], False)
    stop = np.where(same, following + TRIGGER, ends[piece_of[start]])
    size = stop - start
    # the dictionary: distinct phrases by content
    scrambled = (data[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    scrambled ^= scrambled >> np.uint64(32)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scrambled * powers(_bases[0], n))))
    named = (sums[stop] - sums[start]) * powers(pow(_bases[0], -1, 1 << 64), n)[start] + size.astype(np.uint64) * np.uint64(_bases[1])
    order = np.argsort(named)
    new = np.concatenate(([True], named[order[1:]] != named[order[:-1]]))
    first = order[new]
    phrase = np.empty(len(start), dtype=np.int64)
    phrase[order] = np.cumsum(new) - 1
    d_size = size[first]
    d_begin = np.cumsum(d_size) - d_size
    d_data = data[np.repeat(start[first] - d_begin, d_size) + np.arange(int(d_size.sum()))]
    d_left = np.repeat(d_begin + d_size, d_size) - np.arange(len(d_data))
    d_rank = suffix_ranks(leading(d_data, d_left), d_left, 7)
    # the parse: pieces in phrases, ordered by what follows
    per_piece = np.bincount(piece_of[start], minlength=len(pieces))
    p_end = np.repeat(np.cumsum(per_piece), per_piece)
    p_rank = suffix_ranks(d_rank[d_begin[phrase]], p_end - np.arange(len(start)))
    after = np.append(p_rank[1:], 0)
    after[p_end - 1 == np.arange(len(start))] = 0
    # all windows in the order of their suffixes
    place = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
    within = np.cumsum(starts_here)[place] - 1
    key = d_rank[d_begin[phrase[within]] + place - start[within]] * np.int64(len(start) + 1) + after[within]
    order = np.argsort(key)
    words = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=data.tobytes(), strides=(1,))
    a, b = order[:-1], order[1:]
    for t in [*range(0, width - 7, 8), width - 8] if width >= 8 else []:
        equal = words[place[a] + t] == words[place[b] + t]
        a, b = a[equal], b[equal]
    out = np.repeat(times > 1, sizes)
    out[a] = True
    out[b] = True
    return out


class ByteCutter:
    """Windows of `width` bytes; all of equal windows go."""

    first_stays = False
    hot = 6 << 20  # sorted with some 100 bytes of numbers for each

    def __init__(self, width: int = WIDTH) -> None:
        self.width, self.least, self.sampled = width, width, min(SAMPLED, max(1, width // 4))

    def runs(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        lengths = np.array([len(x) for x in texts])
        ends = np.cumsum(lengths)
        begins = ends - lengths
        m = len(data) - self.width + 1
        long = lengths >= self.width
        if not long.any():
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)
        low, at = sliding_least(rolling(data, self.sampled), self.width - self.sampled + 1)
        edge = np.zeros(m + 1, dtype=bool)
        edge[0] = True
        edge[1:m] = low[1:] != low[:-1]
        inside = np.zeros(m + 1, dtype=np.int8)
        edge[begins[long]] = edge[ends[long] - self.width + 1] = True
        inside[begins[long]] += 1
        np.subtract.at(inside, ends[long] - self.width + 1, 1)
        start = np.flatnonzero(edge[:m])
        n = np.diff(np.append(start, m))
        valid = np.cumsum(inside[:m])[start] > 0
        moved = np.concatenate(([0], np.cumsum(at[1:] != at[:-1])))
        several = moved[start + n - 1] > moved[start]
        start, n, several = start[valid], n[valid], several[valid]
        which = np.searchsorted(ends, start, side="right")
        return which, start - begins[which], n, (low[start] * np.uint64(_bases[1])).view(np.int64), several

    def parts(self, text: bytes, most: int) -> list[tuple[int, bytes]]:
        return [(a, text[a : a + most + self.width - 1]) for a in range(0, max(1, len(text) - self.width + 1), most)]

    def windows(self, text: bytes, start: int, n: int) -> list[bytes]:
        return [text[i : i + self.width] for i in range(start, start + n)]

    def pieces(self, text: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
        return [text[start : start + n + self.width - 1] for start, n in runs]

    def repeated(self, group: np.ndarray, pieces: list[bytes], n: np.ndarray) -> np.ndarray:
        at: dict[bytes, int] = {}
        which = np.array([at.setdefault(p, len(at)) for p in pieces])  # a piece's windows follow from its length
        unique = list(at)
        sizes = np.array([len(p) - self.width + 1 for p in unique])
        flags = repeated_windows(unique, sizes, self.width, np.bincount(which))
        return flags[np.repeat((np.cumsum(sizes) - sizes)[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def remove_repeats(docs: DataFrame, path: str, width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept for each row of docs (doc_id, text).

    A byte of a text's UTF-8 goes if a string of `width` bytes covers it that also starts anywhere else, in this
    document or another. Strings are judged on the input and lie in one document. n_spans: maximal runs of removed
    bytes. kept: the bytes left (null unless keep_text). Null and empty texts have no bytes. Rows with equal doc_id
    and text are one document, which each of them stands for; different texts of one doc_id (told apart by 31 bits of a
    hash) are documents of their own. Rows with a null doc_id lose nothing and no other row loses anything to them. An
    empty table gives none.
    """
    base = with_part(id_and_text(docs))
    cutter = ByteCutter(width)
    texts, notes = distinct_texts(base, cutter.least, path)
    found = repeated_spans(texts, cutter, path)
    copies = notes.select("doc_id", "part", F.lit(True).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts_ = [x.as_py().encode() for x in part.column(1)]
                sizes, gone_, runs_, kept_ = [len(x) for x in texts_], [], [], []
                for data, gone, copy in zip(texts_, removed(part.column(2), sizes, width), part.column(3).to_pylist(), strict=True):
                    if copy:
                        gone = np.full(len(data), len(data) >= width)
                    gone_.append(int(np.count_nonzero(gone)))
                    runs_.append(len(spans(gone)[0]) if gone_[-1] else 0)
                    kept_.append(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes() if gone_[-1] else data)
                digests = [hashlib.sha256(x).hexdigest() for x in kept_]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(gone_, pa.int64()), pa.array(runs_, pa.int64()), pa.array(digests), pa.array(kept_ if keep_text else [None] * len(sizes), pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    key = ["doc_id", "part"]
    marked = base.join(found, key, "left").join(copies, key, "left").select("doc_id", "text", "spans", "copy")
    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
