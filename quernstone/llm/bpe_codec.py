"""BPE encoding and decoding with tree concatenation.

A text is normalised and cut into pretokens as the tokenizer file says; each pretoken is one run of symbols to
merge. A run of more than LEAF symbols is cut into halves until they are short, the leaves are encoded, and
neighbours are joined up a tree: a window of k tokens on either side of the join is encoded afresh, and k grows
until the window's first token equals the left side's and its last the right side's. Since a token sequence is
what BPE makes of its string exactly when each adjacent pair is what BPE makes of theirs, the joined sequence is
then the same as an encoding of the whole.

Runs of SPREAD characters and more, which one task should not encode alone, have their leaves dealt over the
cluster; a document's leaves come back together to be joined.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import id_and_text

LEAF = 256
SPREAD = 1 << 16
MEMO = 600_000
#: The characters of Unicode's White_Space property, and the pretoken classes of the tokenizer file.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"


def byte_letters() -> list[str]:
    """The printable character for each byte: itself where printable, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Words(dict):
    """pretoken -> ids as little-endian 32-bit integers; forgets all when full."""

    def __init__(self, codec: Codec, most: int = MEMO) -> None:
        super().__init__()
        self.codec, self.most = codec, most

    def __missing__(self, word: str) -> bytes:
        out = np.asarray(self.codec.encode_run(self.codec.symbols(word)), dtype="<u4").tobytes()
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


class Codec:
    """Encodes and decodes as the tokenizers library does for a BPE file with word ends and lower case."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        cuts = [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if steps != ["NFC", "Replace", "Lowercase"] or cuts != ["Split", "ByteLevel"] or pattern != PRETOKEN or spec["decoder"] or spec["post_processor"] or model["unk_token"] or model["continuing_subword_prefix"]:
            raise ValueError("this tokenizer file has steps that are not known here")
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.pairs: dict[int, int] = {}  # two ids to their merge's rank
        self.merged: list[int] = []  # a rank to the id it makes
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[self.ids[a] << 32 | self.ids[b]] = rank
            self.merged.append(self.ids[a + b])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = [""] * (max([*self.ids.values(), *self.added.values()]) + 1)
        for s, i in [*self.ids.items(), *self.added.items()]:
            self.strings[i] = s
        self.letters = byte_letters()
        self.inner = [self.ids.get(x, -1) for x in self.letters]
        self.last = [self.ids.get(x + self.end, -1) for x in self.letters]
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.pretoken = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        self.words = Words(self)

    def symbols(self, word: str) -> list[int]:
        """The ids of a pretoken's bytes; the last has the word's end. A byte that has no id has no token."""
        data = word.encode()
        out = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
        return [x for x in out if x >= 0] if -1 in out else out

    def merge(self, symbols: list[int]) -> list[int]:
        """Plain BPE: the best-ranked adjacent pair first, the leftmost of equals."""
        n, pairs, merged = len(symbols), self.pairs.get, self.merged
        if n < 2:
            return symbols
        s = [*symbols]
        best = [pairs(a << 32 | b, -1) for a, b in zip(s, s[1:], strict=False)]  # the rank of i with its next
        best.append(-1)
        heap = [rank << 32 | i for i, rank in enumerate(best) if rank >= 0]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if best[i] != rank:
                continue
            new = s[i] = merged[rank]
            j = after[i]
            s[j] = best[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                up = best[i] = pairs(new << 32 | s[k], -1)
                if up >= 0:
                    heappush(heap, up << 32 | i)
            else:
                best[i] = -1
            h = before[i]
            if h >= 0:
                up = best[h] = pairs(s[h] << 32 | new, -1)
                if up >= 0:
                    heappush(heap, up << 32 | h)
        return [x for x in s if x >= 0]

    def spelled(self, tokens: list[int]) -> list[int]:
        """The symbols that tokens were merged from."""
        out: list[int] = []
        for t in tokens:
            s = self.strings[t]
            ended = bool(self.end) and s.endswith(self.end) and t not in self.added.values()
            chars = list(s[: len(s) - len(self.end)] if ended else s)
            if ended:
                chars[-1] += self.end
            out += [self.ids[c] for c in chars]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' whole: growing windows until both sides agree."""
        if not left or not right:
            return left + right
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            window = self.merge(self.spelled(a + b))
            fits_left = len(a) == len(left) or window[0] == a[0]
            fits_right = len(b) == len(right) or window[-1] == b[-1]
            if fits_left and fits_right and (len(window) > 1 or len(a) == len(left) and len(b) == len(right)):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def encode_run(self, symbols: list[int]) -> list[int]:
        if len(symbols) <= LEAF:
            return self.merge(symbols)
        half = len(symbols) // 2
        return self.join(self.encode_run(symbols[:half]), self.encode_run(symbols[half:]))

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """A balanced tree over leaves in their order."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def pretokens(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() has a final form, which the library doesn't use
        return self.pretoken.findall(text.lower())

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        get = self.words.__getitem__
        if "<" not in text or not self.specials.search(text):
            return b"".join(map(get, self.pretokens(text)))
        parts = self.specials.split(text)
        return b"".join(np.uint32(self.added[x]).astype("<u4").tobytes() if i % 2 else b"".join(map(get, self.pretokens(x))) for i, x in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """As the library without a decoder: the tokens' strings, one space between."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[str, Codec] = {}


def codec(file: str) -> Codec:
    """One codec for a worker process."""
    if file not in _codecs:
        _codecs[file] = Codec(file)
    return _codecs[file]


def _rows(doc_ids: list[int], ids: list[bytes], c: Codec, outputs: bool) -> pa.RecordBatch:
    texts = [c.decode(x) for x in ids]
    cols = [
        pa.array(doc_ids, pa.int64()),
        pa.array([len(x) // 4 for x in ids], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts]),
        pa.array(ids if outputs else [None] * len(ids), pa.binary()),
        pa.array(texts if outputs else [None] * len(ids), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])


def encode_decode(docs: DataFrame, file: str, outputs: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded for each row of docs (doc_id, text).

    Null and empty texts have no tokens and decode to the empty text. Repeated rows each give a row. outputs:
    whether ids and decoded are filled. Each of doc_id's rows with a very long run is rebuilt by a row number,
    so doc_id need not be unique.
    """
    base = id_and_text(docs)
    spread = (F.length("text") >= SPREAD) & F.col("text").rlike(rf"\S{{{SPREAD}}}")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _rows(part.column(0).to_pylist(), [c.encode(x.as_py()) for x in part.column(1)], c, outputs)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """row, doc_id, seq, run (-1: encoded already), ids or symbols"""
        c = codec(file)
        for batch in batches:
            for row, doc_id, text in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                out: list[tuple[int, bytes]] = []
                plain: list[bytes] = []
                run = 0
                for i, x in enumerate(c.specials.split(text)):
                    if i % 2:
                        plain.append(np.uint32(c.added[x]).astype("<u4").tobytes())
                        continue
                    for word in c.pretokens(x):
                        if len(word) < SPREAD:
                            plain.append(c.words[word])
                            continue
                        out.append((-1, b"".join(plain)))
                        plain = []
                        symbols = np.asarray(c.symbols(word), dtype="<u4")
                        out += [(run, symbols[k : k + SPREAD // 4].tobytes()) for k in range(0, len(symbols), SPREAD // 4)]
                        run += 1
                out.append((-1, b"".join(plain)))
                for k in range(0, len(out), 64):
                    some = out[k : k + 64]
                    yield pa.RecordBatch.from_pydict({"row": [row] * len(some), "doc_id": pa.array([doc_id] * len(some), pa.int64()), "seq": pa.array(range(k, k + len(some)), pa.int64()), "run": pa.array([r for r, _ in some], pa.int64()), "data": [b for _, b in some]})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file)
        for batch in batches:
            data = [d if r < 0 else np.asarray(c.encode_run(np.frombuffer(d, dtype="<u4").tolist()), dtype="<u4").tobytes() for r, d in zip(batch.column("run").to_pylist(), batch.column("data").to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("data"), "data", pa.array(data, pa.binary()))

    def joined(group: pa.Table) -> pa.Table:
        c = codec(file)
        out, runs = [], {}
        for seq, run, data in sorted(zip(*[group.column(x).to_pylist() for x in ("seq", "run", "data")], strict=True)):
            if run >= 0 and run not in runs:
                runs[run] = []
                out.append(runs[run])
            if run < 0:
                out.append(data)
            else:
                runs[run].append(np.frombuffer(data, dtype="<u4").tolist())
        ids = b"".join(x if isinstance(x, bytes) else np.asarray(c.join_all(x), dtype="<u4").tobytes() for x in out)
        return pa.Table.from_batches([_rows([group.column("doc_id")[0].as_py()], [ids], c, outputs)])

    plain = base.filter(~spread).mapInArrow(short, SCHEMA)
    long = base.filter(spread).select(F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id()).alias("row"), "doc_id", "text")
    kind = "row string, doc_id long, seq long, run long, data binary"
    dealt = long.mapInArrow(leaves, kind).repartition(F.col("row"), F.col("seq")).mapInArrow(encoded, kind)
    return plain.unionByName(dealt.groupBy("row").applyInArrow(joined, SCHEMA))
