"""Finding all repeated windows of a fixed length, for the two substring operators.

A cutter gives each window of a text an owner: a name that depends on the window's content alone and changes
seldom from one window to the next. Equal windows thus have equal owners, so

1. every text is cut into runs of windows with one owner; owners that occur once are dropped by counting;
2. texts meet what is left of their runs and send each run's piece of text to its owner;
3. an owner compares its windows exactly and reports which repeat;
4. a text collects its reports.

Identical texts are one text from the start. An owner whose runs hold more than the cutter's `hot` tokens does not go
to one task: its windows, each named by a 128-bit BLAKE2 digest of its content, are dealt out as rows and compared in
order as they pass, so no task holds more than `hot` tokens of one owner, however many texts share it.

A text is known by its doc_id and its part, 31 bits of a hash of the text. Where a doc_id has one text, part says
nothing new; where it has several, they are documents of their own, in the order of part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import remove, settle, without

#: Rows that a task gathers, whole owners at a time, before it compares them.
BLOCK = 8_192
BLOCK_BYTES = 4 << 20
#: Windows that are named at a time.
HELD = 1 << 14
#: Texts whose pieces go out in one batch; pieces overlap, so they take several times the texts' bytes.
SENT = 32
#: Bytes of text that are cut at a time.
PART = 1 << 19


class Cutter(Protocol):
    """How an operator sees texts."""

    first_stays: bool
    #: Tokens (words or bytes) of one owner that a task may hold.
    hot: int
    #: Tokens of a window, and the fewest bytes they take.
    width: int
    least: int

    def runs(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Runs of windows with one owner: which text, first window, number, owner, and whether the owner occurs at
        several places of these texts."""

    def parts(self, text: bytes, most: int) -> list[tuple[int, bytes]]:
        """A long text in parts that together have each window once: first window and text of each."""

    def windows(self, text: bytes, start: int, n: int) -> list[bytes]:
        """The content of windows start to start + n - 1."""

    def pieces(self, text: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
        """For each start and n the text that windows start to start + n - 1 cover."""

    def repeated(self, group: np.ndarray, pieces: list[bytes], n: np.ndarray) -> np.ndarray:
        """Which windows repeat within their group (a number for each owner), those of all pieces in a row; pieces
        come in the order of group, document, start. With first_stays the first of equal windows is not marked."""


def with_part(docs: DataFrame) -> DataFrame:
    """docs (text and others) with the part each text has under its doc_id."""
    return docs.withColumn("part", F.shiftrightunsigned(F.xxhash64("text"), 33).cast("int"))


def distinct_texts(base: DataFrame, least: int, path: str) -> tuple[DataFrame, DataFrame]:
    """Of base (doc_id, part, text), texts of at least `least` bytes: the different texts, each under the smallest
    doc_id and part that has it, and the notes doc_id, part, rep_id, rep_part of those that others have too."""
    known = base.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= least))
    keyed = known.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    per = settle(keyed.groupBy("sha", "doc_id", "part").agg(F.count("*").alias("rows")), f"{path}/per")
    groups = settle(per.groupBy("sha").agg(F.min(F.struct("doc_id", "part")).alias("rep"), F.count("*").alias("texts")).filter("texts > 1").select("sha", "rep"), f"{path}/groups")
    notes = settle(per.join(groups, "sha").select("doc_id", "part", F.col("rep.doc_id").alias("rep_id"), F.col("rep.part").alias("rep_part")), f"{path}/twins")
    texts = without(known, notes.filter("doc_id <> rep_id or part <> rep_part"), ["doc_id", "part"])
    again = settle(per.filter("rows > 1").select("doc_id", "part"), f"{path}/again")
    if not again.isEmpty():
        one = texts.join(again, ["doc_id", "part"], "left_semi").dropDuplicates(["doc_id", "part"])
        texts = texts.join(again, ["doc_id", "part"], "left_anti").unionByName(one)
    for name in ("per", "groups"):
        remove(base.sparkSession, f"{path}/{name}")
    return texts.select("doc_id", "part", "text"), notes


def _sized(batch: pa.RecordBatch, cutter: Cutter) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Groups of document, part, first window and text, of about PART bytes each, so memory does not follow the rows."""
    group, held = [], 0
    for doc_id, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        data = text.as_py().encode()
        for first, stretch in [(0, data)] if len(data) <= PART else cutter.parts(data, PART):
            group.append((doc_id, part, first, stretch))
            held += len(stretch)
            if held >= PART:
                yield group
                group, held = [], 0
    if group:
        yield group


def _runs(cutter: Cutter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _sized(batch, cutter):
                ids, parts, first = (np.array([x[k] for x in group]) for k in range(3))
                which, start, n, owner, several = cutter.runs([x[3] for x in group])
                if len(which):
                    cols = [owner, ids[which], parts[which], first[which] + start, n, several.astype(np.int32) + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["owner", "doc_id", "part", "start", "n", "weight"])

    return run


def _listed(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many entries each row's list has, and the entries' fields, all rows in a row."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return sizes, [x.to_numpy(zero_copy_only=False) for x in pc.list_flatten(column).flatten()]


def _pieces(cutter: Cutter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of doc_id, part, text, runs: a row for each run; `at` is part and start in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SENT):
                some = batch.slice(at, SENT)
                sizes, (owner, start, n) = _listed(some.column(3))
                pairs, pieces, k = list(zip(start.tolist(), n.tolist(), strict=True)), [], 0
                for text, size in zip(some.column(2), sizes.tolist(), strict=True):
                    pieces += cutter.pieces(text.as_py().encode(), pairs[k : k + size])
                    k += size
                docs, part = (np.repeat(some.column(c).to_numpy().astype(np.int64), sizes) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((owner, docs, part << 32 | start, n, pieces), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["owner", "doc_id", "at", "n", "piece"])

    return run


def _hot_windows(cutter: Cutter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of doc_id, part, text, runs: a row for each window, with its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, part, text, runs in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                data = text.encode()
                for r in runs:
                    for a in range(r["start"], r["start"] + r["n"], HELD):
                        n = min(HELD, r["start"] + r["n"] - a)
                        digests = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in cutter.windows(data, a, n))
                        h = np.frombuffer(digests, dtype=np.int64).reshape(n, 2)
                        at = (part << 32) + np.arange(a, a + n, dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(np.full(n, doc_id), pa.int64()), pa.array(at)], ["h1", "h2", "doc_id", "at"])

    return run


def _again(first_stays: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of windows sorted by digest, document and place: those that repeat; one row is carried from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = [np.zeros(0, np.int64)] * 4, False  # the last row, and whether it is one of several
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns, strict=True)]
            same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
            marked = np.concatenate(([met], same))
            if not first_stays:
                marked[:-1] |= same
            met = bool(marked[-1])
            keep = marked.copy()
            keep[-1] = False  # the next batch tells
            held = [c[-1:] for c in cols]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(cols[2][keep]), pa.array(cols[3][keep]), pa.array(np.ones(int(keep.sum()), np.int32))], ["doc_id", "at", "n"])
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(held[2]), pa.array(held[3]), pa.array([1], pa.int32())], ["doc_id", "at", "n"])

    return run


_power_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the power of 0 to n - 1, modulo 2**64; kept for the process up to the largest n so far."""
    have = _power_cache.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = _power_cache[base] = np.multiply.accumulate(have)
    return have[:n]


def chunks(pieces: list[bytes], most: int) -> Iterator[list[bytes]]:
    """The pieces in order, about `most` bytes at a time."""
    some, held = [], 0
    for x in pieces:
        some.append(x)
        held += len(x)
        if held >= most:
            yield some
            some, held = [], 0
    if some or not pieces:
        yield some


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def _compared(cutter: Cutter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            owner, doc, start, n = (table.column(x).to_numpy() for x in ("owner", "doc_id", "at", "n"))
            flags = cutter.repeated(owner, table.column("piece").to_pylist(), n)
            first = np.cumsum(n) - n
            begins = np.zeros(len(flags) + 1, dtype=bool)
            begins[first] = begins[-1] = True
            at = np.flatnonzero(flags & (begins[:-1] | ~np.concatenate(([False], flags[:-1]))))
            end = np.flatnonzero(flags & (begins[1:] | ~np.concatenate((flags[1:], [False]))))
            if len(at):
                row = np.searchsorted(first, at, side="right") - 1
                cols = doc[row], start[row] + at - first[row], end - at + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "at", "n"])

        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:  # sorted by owner: whole owners are compared once enough rows or bytes are held
            held.append(batch)
            rows += batch.num_rows
            size += batch.nbytes
            if rows >= BLOCK or size >= BLOCK_BYTES:
                table = pa.Table.from_batches(held)
                owner = table.column("owner").to_numpy()
                cut = int(np.searchsorted(owner, owner[-1]))
                if cut:
                    yield from done(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows, size = table.num_rows - cut, 0
        if held:
            yield from done(pa.Table.from_batches(held))

    return run


def repeated_spans(texts: DataFrame, cutter: Cutter, path: str) -> DataFrame:
    """doc_id, part, spans (array of start, n: windows that repeat) for different texts (doc_id, part, text)."""
    spark, key = texts.sparkSession, ["doc_id", "part"]
    runs = settle(texts.mapInArrow(_runs(cutter), "owner long, doc_id long, part int, start int, n int, weight int"), f"{path}/runs")
    tokens = F.sum(F.col("n").cast("long") + cutter.width - 1)
    counts = runs.groupBy("owner").agg(F.sum("weight").alias("m"), tokens.alias("tokens")).filter("m > 1").select("owner", (F.col("tokens") > cutter.hot).alias("hot"))
    run = F.struct("owner", "start", "n")
    shared = runs.select("owner", "doc_id", "part", "start", "n").join(counts, "owner").groupBy(key).agg(F.collect_list(F.when(~F.col("hot"), run)).alias("cool"), F.collect_list(F.when(F.col("hot"), run)).alias("warm"))
    lists = settle(shared, f"{path}/shared")
    remove(spark, f"{path}/runs")
    met = texts.join(lists.filter("size(cool) > 0").select(*key, "cool"), key).select(*key, "text", "cool")
    pieces = met.mapInArrow(_pieces(cutter), "owner long, doc_id long, at long, n int, piece binary")
    found = pieces.repartition("owner").sortWithinPartitions("owner", "doc_id", "at").mapInArrow(_compared(cutter), "doc_id long, at long, n int")
    warm = lists.filter("size(warm) > 0").select(*key, "warm")
    if not warm.isEmpty():
        windows = texts.join(warm, key).select(*key, "text", "warm").mapInArrow(_hot_windows(cutter), "h1 long, h2 long, doc_id long, at long")
        found = found.unionByName(windows.repartition("h1").sortWithinPartitions("h1", "h2", "doc_id", "at").mapInArrow(_again(cutter.first_stays), "doc_id long, at long, n int"))
    span = F.struct(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("start"), "n")
    found = settle(found.groupBy("doc_id", F.shiftright("at", 32).cast("int").alias("part")).agg(F.collect_list(span).alias("spans")), f"{path}/found")
    remove(spark, f"{path}/shared")
    return found


def removed(spans_: pa.ListArray, lengths: list[int], width: int) -> Iterator[np.ndarray]:
    """For each row which of its tokens the windows in its spans cover."""
    sizes, fields = _listed(spans_)
    start, stop = (fields[0], fields[0] + fields[1] - 1 + width) if fields else (np.zeros(0, int), np.zeros(0, int))
    k = 0
    for size, n in zip(sizes.tolist(), lengths, strict=True):
        step = np.bincount(start[k : k + size], minlength=n + 1)[: n + 1] - np.bincount(np.minimum(stop[k : k + size], n), minlength=n + 1)[: n + 1]
        yield np.cumsum(step[:n]) > 0
        k += size
