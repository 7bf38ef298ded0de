"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints differ in at most two bits, then
either their low segments differ in at most one bit or their high segments are equal. So each fingerprint is
entered in a table under each segment; it looks up the low segment's Hamming ball of radius one and the high
segment itself, and the complete distance of what it finds is verified.

A segment value that very many different fingerprints share would give all their pairs. Those fingerprints, and
the ones that look such a value up, instead enter the Hamming ball of radius one round their whole fingerprint:
two within distance two share a point of it, and a point has at most 65 fingerprints, all within two of each
other. That is exact as well and linear.

`near_copies` answers for a similarity instead of a distance: texts link if the Jaccard similarity of their sets of
shingles is LEAST or more. At that similarity some 15 of 100 bits differ, so its fingerprints have SEGMENTS segments of
log2(texts) bits, 16 at least, and a segment's Hamming ball is enumerated over its least certain bits alone, those whose
counts are nearest to a half. Texts that share a point of a ball are verified by a complete distance over 304 bits and
their sizes, then by one over 2,048 bits, then by the exact similarity. In a simulation with 16 to 24 bits a segment, a pair at LEAST was missed once in
100 at most (sets of 7 to 300 shingles); sets of 4 and 5 are given larger balls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import id_and_text, id_map, may_be_in, remove, settle
from quernstone.llm.components import components

HEAVY = 64
SHINGLE = 5
LEAST = 0.8
SEGMENTS = 24
#: Texts of a ball's point up to which all its pairs are looked at; of more, those with some of its texts.
CROWD = 16
#: Words of a fingerprint that go with a ball's point, and differing bits of them up to which texts are compared: of 304, a
#: pair at LEAST has 46, give or take 6.
PRINTS = ["f0", "f1", "f2", "f3", "f4"]
FAR = 68
#: Steps of the number of shingles from 4 to 5, the most that LEAST allows; the fingerprint's last 16 bits hold it in such steps.
STEPS = 64
#: Words of the long fingerprint, and differing bits of it up to which sets of more than FEW shingles are compared: a pair at LEAST has
#: 324 at most, give or take 17. Small sets take no more bytes than the fingerprint.
LONG = 32
WIDE = 390
FEW = 32
#: Bits of a segment that are flipped, at most.
FLIPS = 4
#: Pairs of one text that are compared in one task.
SHARE = 256
_lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """As a signed 64-bit number; zero for a text without words."""
    words = text.encode().translate(_lower).split()
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(data, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(data[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)
    columns = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, j], minlength=256) @ _bits for j in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], pa.int64())], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def links(classes: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """a, b: links between the ids of classes (fp, id; different fingerprints) at distance two or less.

    The links have the same components as all pairs within that distance; pairs with no heavy segment are all there.
    """
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    entry = F.array(F.struct(F.lit(0).alias("i"), low.alias("v")), F.struct(F.lit(1).alias("i"), high.alias("v")))
    table = classes.select("fp", "id", F.explode(entry).alias("e")).select("fp", "id", "e.i", "e.v")
    ball = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.lit(0).alias("i"), low.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)).alias("v")))
    looked = classes.select("fp", "id", F.explode(F.concat(entry, ball)).alias("e")).select("fp", "id", "e.i", "e.v")
    crowded = table.groupBy("i", "v").agg(F.count("*").alias("n")).filter(F.col("n") > heavy).select("i", "v")
    light = table.join(crowded, ["i", "v"], "left_anti").select("i", "v", F.col("fp").alias("fp2"), F.col("id").alias("id2"))
    near = looked.join(light, ["i", "v"]).filter((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= 2)).select(F.col("id").alias("a"), F.col("id2").alias("b"))
    some = looked.join(crowded, ["i", "v"]).select("fp", "id").distinct()
    around = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    points = some.select("id", F.explode(around).alias("point")).groupBy("point").agg(F.collect_set("id").alias("ids")).filter(F.size("ids") > 1)
    stars = points.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).filter("a <> b")
    return near.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, path: str, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for each row of docs.

    Null and empty texts have no words and the fingerprint zero, and link like any other; a text of fewer words
    than a shingle is one shingle. Rows that repeat a doc_id each give a row; a null doc_id takes part in no
    component and keeps a null component_id unless its fingerprint has other rows. path: a shared folder.
    """
    fps = settle(fingerprints(docs, shingle), f"{path}/fps")
    classes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), f"{path}/classes")
    found = components(links(classes.filter("id is not null")), path)
    labelled = classes.join(found, classes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(labelled, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted different 64-bit hashes of the shingles; fewer words than a shingle are one."""
    digest = xxhash.xxh64_intdigest
    data = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(data, 42)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    return np.unique(np.array([digest(data[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64))


def _tallies(hashes: np.ndarray, words: int) -> np.ndarray:
    """How many of the hashes have each of 64 * words derived bits set."""
    out = np.zeros(64 * words, dtype=np.int64)
    salts = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 1024):
        h = (hashes[at : at + 1024, None] ^ salts) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        out += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return out


def segments(sets: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each set of hashes its segments, the least certain bits of each, how many of them are flipped, and 304 bits of its
    fingerprint with its size."""
    words = -(-SEGMENTS * width // 64)
    tally = np.stack([_tallies(x, words) for x in sets])
    sizes = np.array([len(x) for x in sets])[:, None]
    bits, doubt = tally * 2 > sizes, np.abs(tally * 2 - sizes - 0.5)
    whole = np.packbits(bits[:, : 64 * len(PRINTS)], axis=1, bitorder="little").view(np.int64)
    scale = np.minimum(np.rint(STEPS * np.log(sizes[:, 0]) / np.log(1.25)), (1 << 15) - 1).astype(np.int64)
    whole[:, -1] = whole[:, -1] & ((1 << 48) - 1) | scale << 48
    cut = (len(sets), SEGMENTS, width)
    value = bits[:, : SEGMENTS * width].reshape(cut) @ (np.int64(1) << np.arange(width, dtype=np.int64))
    order = np.argsort(doubt[:, : SEGMENTS * width].reshape(cut), axis=2, kind="stable")[:, :, :FLIPS]
    usual = 2 if width <= 18 else 3 if width <= 22 else FLIPS
    return value, order, np.where(sizes[:, 0] > 8, usual, FLIPS), whole  # bits of few shingles are less certain


def ball_points(value: np.ndarray, order: np.ndarray, flipped: int) -> np.ndarray:
    """The points of the balls of a set's segments, as signed numbers."""
    names = (np.arange(1, SEGMENTS + 1, dtype=np.uint64) << np.uint64(40))[:, None]
    flips = np.int64(1) << order[:, :flipped].astype(np.int64)
    chosen = (np.arange(1 << flipped)[:, None] >> np.arange(flipped) & 1).astype(np.int64)
    points = (value.astype(np.int64)[:, None] ^ (flips @ chosen.T)).astype(np.uint64) | names
    points = (points ^ (points >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (points ^ (points >> np.uint64(32))).ravel().view(np.int64)


def _words(text: pa.Scalar) -> list[bytes]:
    return text.as_py().encode().translate(_lower).split()


def _keyed(width: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of doc_id and text: a digest of the words, and what makes the points (segments, bits, how many), so no text is exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                words = [_words(x) for x in part.column(1)]
                keys = [xxhash.xxh128_digest(b" ".join(x)) for x in words]
                value, order, flipped, prints = segments([shingles(x, size) for x in words], width)
                cuts = [v + o for v, o in zip(map(np.ndarray.tobytes, value.astype(np.uint32)), map(np.ndarray.tobytes, order.astype(np.uint8)), strict=True)]
                cols = [pa.array(keys, pa.binary()), pa.array(cuts, pa.binary()), pa.array(flipped, pa.int32()), *(pa.array(x.copy()) for x in prints.T)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "words", "cuts", "flipped", *PRINTS])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of doc_id, cuts, flipped, prints: a row for each point."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            found = []
            for cuts, flipped in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                value = np.frombuffer(cuts, dtype=np.uint32, count=SEGMENTS)
                found.append(ball_points(value, np.frombuffer(cuts, dtype=np.uint8, offset=4 * SEGMENTS).reshape(SEGMENTS, FLIPS), flipped))
            n = [len(points) for points in found]
            cols = [np.concatenate(found), *(np.repeat(part.column(c).to_numpy(), n) for c in ("doc_id", *PRINTS))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["point", "id", *PRINTS])


def _sets(size: int, asked: Callable[[pa.Array], pa.Array]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of doc_id, text and slot, where the slot is asked for: the shingles, their number and their long fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(asked(batch.column(2)))
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [shingles(_words(x), size) for x in part.column(1)]
                long = [np.packbits(_tallies(x, LONG) * 2 > len(x), bitorder="little").view(np.int64) for x in found]
                cols = [pa.array([len(x) for x in found], pa.int32()), pa.array(long, pa.list_(pa.int64())), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["id", "n", "long", "shingles"])

    return run


def _near(prints: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    *whole, last = prints
    x, y = last[i], last[j]
    bits = np.bitwise_count(((x ^ y) << 16).view(np.uint64)).astype(np.int64)
    for f in whole:
        bits += np.bitwise_count((f[i] ^ f[j]).view(np.uint64))
    return (bits <= FAR) & (np.abs((x >> 48) - (y >> 48)) <= STEPS + 1)


def _wide() -> Column:
    """Whether long fingerprints long and p_long of sets of n and p_n shingles are near, on all their bits and on those of `_near`,
    and the sizes fit."""
    differ = [F.bit_count(F.get("long", F.lit(k)).bitwiseXOR(F.get("p_long", F.lit(k)))) for k in range(LONG)]
    cut = F.bit_count(F.shiftleft(F.get("long", F.lit(len(PRINTS) - 1)).bitwiseXOR(F.get("p_long", F.lit(len(PRINTS) - 1))), 16))
    few, many = F.least("n", "p_n"), F.greatest("n", "p_n")
    return (few >= LEAST * many - 1e-9) & (sum(differ[: len(PRINTS) - 1], cut) <= FAR) & ((few <= FEW) | (sum(differ[1:], differ[0]) <= WIDE))


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (point, id, prints) sorted by point and id: the near pairs (a, b) of a point with up to CROWD texts; of another
    the pairs with its first text, and its rows once more (a, b null, point)."""

    def rows(a: np.ndarray, b: np.ndarray | None, point: np.ndarray | None = None) -> pa.RecordBatch:
        empty = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), *(empty if x is None else pa.array(x) for x in (b, point))], ["a", "b", "point"])

    def light(point: np.ndarray, id_: np.ndarray, *prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, i = [np.zeros((0, 2), np.int64)], np.arange(len(point))
        for lag in range(1, CROWD):
            i = i[i + lag < len(point)]
            i = i[point[i] == point[i + lag]]
            if not len(i):
                break
            hit = i[_near(list(prints), i, i + lag) & (id_[i] != id_[i + lag])]
            found.append(np.stack((id_[hit], id_[hit + lag]), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        if len(pairs):
            yield rows(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

    def crowded(first: list[int], cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        point, id_, *prints = cols
        n = len(point)
        hit = np.flatnonzero(_near([np.append(f, x) for f, x in zip(prints, first[2:], strict=True)], np.arange(n), np.full(n, n)) & (id_ != first[1]))
        yield rows(np.full(len(hit), first[1]), id_[hit])
        yield rows(id_, None, point)

    held, first = [np.zeros(0, np.int64)] * (2 + len(PRINTS)), None
    for batch in batches:
        cols = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns, strict=True)]
        if first is not None:  # a crowded point goes on
            k = int(np.searchsorted(cols[0], first[0], side="right"))
            if k:
                yield from crowded(first, [c[:k] for c in cols])
            cols = [c[k:] for c in cols]
            if not len(cols[0]):
                held = cols
                continue
            first = None
        begin = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
        size = np.diff(np.append(begin, len(cols[0])))
        done = np.repeat((size <= CROWD) & (np.arange(len(size)) < len(size) - 1), size)
        yield from light(*(c[done] for c in cols))
        for a, n in zip(begin[size > CROWD].tolist(), size[size > CROWD].tolist(), strict=True):
            some = [c[a : a + n] for c in cols]
            head = [int(c[0]) for c in some]
            first = head if a == begin[-1] else None
            yield from crowded(head, some)
        held = [c[len(c) :] if first is not None else c[begin[-1] :] for c in cols]
    yield from light(*held)


def _near_ones(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose long fingerprints are near."""
    long = sets.select("id", "n", "long")
    mine = long.select(F.col("id").alias("a"), F.col("n").alias("p_n"), F.col("long").alias("p_long"))
    return pairs.join(mine, "a").join(long.withColumnRenamed("id", "b"), "b").filter(_wide()).select("a", "b")


def _compared(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are similar; a text that is in very many pairs is dealt out with them."""
    some = sets.filter(may_be_in(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())(F.col("id")))
    dealt = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("shares")), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("s"))
    mine = dealt.select("a", "s").distinct().join(some.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = dealt.join(some.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(mine, ["a", "s"])
    few, many = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter((few >= least * many - 1e-9) & (shared >= least * (few + many - shared) - 1e-9)).select("a", "b")


def near_copies(docs: DataFrame, path: str, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable) for each different doc_id of docs (doc_id, text).

    Texts of the same words (ASCII letters in lower case) are one; texts without words are all alike. Rows without
    doc_id are left out; rows that repeat one give one row, their different texts link what either links, and one of
    them is verified. An empty table gives none. path: a shared folder.

    All near pairs of a point with up to CROWD texts are verified. Of a crowded point, first the pairs with one of its
    texts; then, from round to round, those with eight times as many others, of texts that no chain of links joins to the point's
    largest component. It ends when each two near texts of a point are linked by a chain or compared.
    """
    if least < LEAST:
        raise ValueError(f"segments and distances are laid out for a similarity of {LEAST} or more")
    spark = docs.sparkSession
    known = id_and_text(docs).filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    width = max(16, min(32, max(1, known.count()).bit_length()))
    prints = ", ".join(f"{c} long" for c in PRINTS)
    keyed = settle(known.mapInArrow(_keyed(width, shingle), f"doc_id long, words binary, cuts binary, flipped int, {prints}"), f"{path}/keyed")
    groups = settle(keyed.groupBy("words").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).filter("n > 1").select("words", "id"), f"{path}/alike")
    copies = settle(keyed.select("doc_id", "words").join(groups, "words").filter("doc_id <> id").select("doc_id", "id", "words").distinct(), f"{path}/copies")
    others = keyed.select("doc_id", "words").join(copies.select("doc_id").distinct(), "doc_id", "left_semi").join(copies, ["doc_id", "words"], "left_anti").select("doc_id").distinct()
    chosen = keyed.join(copies.select("doc_id").distinct().join(others, "doc_id", "left_anti"), "doc_id", "left_anti")
    entries = chosen.select("doc_id", "cuts", "flipped", *PRINTS).mapInArrow(_entries, f"point long, id long, {prints}")
    met = settle(entries.repartition("point").sortWithinPartitions("point", "id").mapInArrow(_meetings, "a long, b long, point long"), f"{path}/met")
    crowd = met.filter("b is null").select("point", F.col("a").alias("id"))
    pairs = settle(met.filter("b is not null").select("a", "b").distinct(), f"{path}/pairs")
    some = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowd.select("id")).distinct()
    slot, asked_for = id_map(some)
    made = known.withColumn("slot", slot(F.col("doc_id"))).mapInArrow(_sets(shingle, asked_for), "id long, n int, long array<long>, shingles array<long>")
    repeats = not keyed.groupBy("doc_id").count().filter("count > 1").isEmpty()
    sets = settle(made.dropDuplicates(["id"]) if repeats else made, f"{path}/sets")
    long = sets.select("id", "n", "long")
    near = settle(_near_ones(pairs, sets), f"{path}/near")
    found = settle(_compared(near, sets, least), f"{path}/similar")
    linked = copies.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).unionByName(found)
    label = settle(components(linked, f"{path}/0"), f"{path}/label-0")
    done = None
    for k in range(1, 32):
        # the texts of a crowded point by component; the largest needs no pivot, as all others look at it
        at = crowd.join(label, crowd["id"] == label["node"], "left").select("point", "id", F.coalesce("component", "id").alias("c"))
        at = at.withColumn("done", F.lit(False)) if done is None else at.join(done, ["point", "id"], "left").select("point", "id", "c", F.coalesce("done", F.lit(False)).alias("done"))
        sizes = at.groupBy("point", "c").agg(F.count("*").alias("m"))
        main = sizes.groupBy("point").agg(F.max(F.struct("m", (-F.col("c")).alias("c"))).alias("x"), F.count("*").alias("cs")).filter("cs > 1").select("point", (-F.col("x.c")).alias("main"))
        at = settle(at.join(main, "point"), f"{path}/at-{k}")
        turn = F.row_number().over(Window.partitionBy("point").orderBy(F.xxhash64("id"), "id"))
        waiting = at.filter("c <> main and not done").withColumn("turn", turn)
        pivots = settle(waiting.filter(F.col("turn") <= 8 ** (k + 1)).select("point", F.col("id").alias("p"), F.col("c").alias("pc")), f"{path}/pivots-{k}")
        if pivots.isEmpty():
            break
        theirs = pivots.join(long.select(F.col("id").alias("p"), F.col("n").alias("p_n"), F.col("long").alias("p_long")), "p")
        others = at.select("point", "id", "c").join(pivots.select("point").distinct(), "point", "left_semi").join(long, "id")
        asked = settle(others.join(theirs, "point").filter((F.col("c") != F.col("pc")) & _wide()).select(F.col("p").alias("a"), F.col("id").alias("b")).distinct(), f"{path}/asked-{k}")
        now = pivots.select("point", F.col("p").alias("id"), F.lit(True).alias("done"))
        done = settle(now if done is None else done.unionByName(now), f"{path}/done-{k}")
        if asked.isEmpty():
            continue
        found = settle(_compared(asked, sets, least), f"{path}/similar-{k}")
        linked = label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)
        label = settle(components(linked, f"{path}/{k}"), f"{path}/label-{k}")
    else:
        raise RuntimeError("texts of a crowded point are not all compared")
    own = keyed.select("doc_id").distinct()
    out = settle(own.join(label, own["doc_id"] == label["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id")), f"{path}/out")
    for name in ("keyed", "alike", "copies", "met", "pairs", "sets", "near", "similar"):
        remove(spark, f"{path}/{name}")
    return out
