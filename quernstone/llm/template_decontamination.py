"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, other words into lower case. Windows
of WINDOW template words of documents and of benchmark items are hash-joined. Matches of one document and item are
gathered by their offset from each other; an offset counts if its slots are consistent, that is, if each value of
the item stands for one value of the document throughout. So a question whose numbers or names were changed is
caught as well, and told apart from a verbatim copy.

A bit map of fixed size, built from the benchmark, spares the join most windows of documents; it only ever lets
windows through that the join then drops.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import id_and_text, settle

WINDOW = 5
LITERALS = 3
COVER = 0.6
MAP_BITS = 23
#: Units that may follow a number, and symbols that are units by themselves.
UNITS = {"mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "ms", "h", "hr", "hrs", "min", "mins", "kb", "mb", "gb", "tb", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "kwh", "mph", "ft", "in", "lb", "lbs", "oz", "mi", "percent", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "metre", "metres", "meter", "meters", "mile", "miles", "gram", "grams", "litre", "litres", "liter", "liters", "degree", "degrees"}
SYMBOLS = "%$€£°"

_token = re.compile(rf"[^\W\d_]+|\d+(?:[.,]\d+)*|[{SYMBOLS}]|[.!?\n]")
WORD, CAPITAL, NUMBER, UNIT, SYMBOL, END = range(6)
_slot = {NUMBER: 0xA24BAED4963EE407, CAPITAL: 0x9FB21C651E98DF25, UNIT: 0xD6E8FEB86659FD93}


class _Vocabulary(dict):
    """token -> place in the tables of hashes and kinds; starts anew when full."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most, self.hash, self.kind = most, np.zeros(most, np.uint64), np.zeros(most, np.int8)

    def __missing__(self, token: str) -> int:
        i = self[token] = len(self)
        first = token[0]
        if first in ".!?\n":
            kind = END
        elif first in SYMBOLS:
            kind = SYMBOL
        elif first.isdigit():
            kind = NUMBER
        elif token.lower() in UNITS:
            kind = UNIT
        else:
            kind = CAPITAL if len(token) > 1 and first.isupper() and token[1:].islower() else WORD
        self.hash[i], self.kind[i] = xxhash.xxh64_intdigest(token.lower()), kind
        return i

    def places(self, tokens: list[str]) -> np.ndarray:
        if len(self) + len(tokens) > self.most:
            self.clear()
            if len(tokens) > self.most:
                self.most = 2 * len(tokens)
                self.hash, self.kind = np.zeros(self.most, np.uint64), np.zeros(self.most, np.int8)
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))


_vocabulary = _Vocabulary()


def template(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Hashes of the template's words, which of them are slots, which may be names, and the words as they stand.

    A capitalised word is a name unless it begins a sentence, where it may be one; a unit is a slot if it follows a number.
    """
    tokens = _token.findall(text)
    at = _vocabulary.places(tokens)
    kind, code = _vocabulary.kind[at], _vocabulary.hash[at]
    begins = np.concatenate(([True], kind[:-1] == END))
    after_number = np.concatenate(([False], kind[:-1] == NUMBER))
    number, name, unit = kind == NUMBER, (kind == CAPITAL) & ~begins, (kind == SYMBOL) | (kind == UNIT) & after_number
    for which, k in ((number, NUMBER), (name, CAPITAL), (unit, UNIT)):
        code = np.where(which, np.uint64(_slot[k]), code)
    kept, maybe = kind != END, (kind == CAPITAL) & begins
    return code[kept], (number | name | unit)[kept], maybe[kept], [tokens[i] for i in np.flatnonzero(kept)] if not kept.all() else tokens


def windows(code: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each window, and whether it has enough words that are no slots."""
    m = len(code) - size + 1
    if m < 1:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    acc = np.full(m, size, dtype=np.uint64)
    for j in range(size):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + code[j : j + m]
    acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    total = np.concatenate(([0], np.cumsum(~slot)))
    return acc ^ (acc >> np.uint64(29)), total[size:] - total[:m] >= min(LITERALS, size)


def spots(code: np.ndarray, slot: np.ndarray, maybe: np.ndarray, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], list[str]]]]:
    """Places of windows, their hashes and a way to their slots' values: with sentence beginnings as words, then as names.

    The second has only windows with a capitalised beginning. Both sides of the join have both, so neither needs to know
    whether the other's word is a name.
    """
    for second in (False, True):
        if second:
            if not maybe.any():
                return
            code, slot = np.where(maybe, np.uint64(_slot[CAPITAL]), code), slot | maybe
        hashes, enough = windows(code, slot, WINDOW)
        if second and len(hashes):
            total = np.concatenate(([0], np.cumsum(maybe)))
            enough = enough & (total[WINDOW:] > total[: len(hashes)])
        at = np.flatnonzero(enough)
        yield at, hashes[at], lambda which, slot=slot: ["\x1f".join(words[i + j] for j in range(WINDOW) if slot[i + j]) for i in which.tolist()]


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << MAP_BITS) - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(40) & mask).astype(np.int64)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            code, slot, maybe, words = template(text)
            found = [x for x in spots(code, slot, maybe, words) if len(x[0])]
            if not found:
                continue
            first: dict[str, int] = {}
            equal = np.array([first.setdefault(words[i], len(first)) for i in np.flatnonzero(slot | maybe).tolist()], dtype=np.int32)
            whole = xxhash.xxh64_intdigest(code.tobytes() + equal.tobytes()) - (1 << 63)
            n = len(np.unique(np.concatenate([at for at, *_ in found])))
            for at, hashes, values in found:
                k = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([item] * k, pa.int64()), pa.array([whole] * k, pa.int64()), pa.array(at, pa.int64()), pa.array(hashes.view(np.int64)), pa.array(values(at)), pa.array([n] * k, pa.int64())], ["item_id", "template", "item_pos", "h", "item_values", "n_windows"])



def _consistent(pairs: F.Column) -> F.Column:
    """Whether each item value stands for one document value: as many pairs as item values."""
    return F.size(F.array_distinct(pairs)) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["item"])))


def contaminated(docs: DataFrame, benchmark: DataFrame, path: str, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, items, n_windows, n_matched, coverage, verbatim: a row for each document and item it holds.

    docs (doc_id, text), benchmark (item_id, text). A document holds an item if the offsets with consistent slots
    match at least `cover` of the item's windows. items: all items of one template whose slots are equal to each other
    in the same places, which are as consistent with a document as one of them; verbatim: no slot has another value than
    in one of them. item_id is the smallest of those, or of all if there is none. Items with fewer than WINDOW template
    words, or no window with LITERALS words that are no slots, cannot be recognised and match nothing; null texts
    and null ids likewise. Repeated document rows give one row. No items or no documents: no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).filter("item_id is not null and text is not null")
    kind = "item_id long, template long, item_pos long, h long, item_values string, n_windows long"
    parts = settle(items.mapInArrow(_item_windows, kind), f"{path}/items")
    classes = parts.groupBy("template").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    first = classes.select(F.explode(F.slice("items", 1, 1)).alias("item_id"), "template", "items")
    mask = (1 << MAP_BITS) - 1
    places = parts.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 40).bitwiseAND(F.lit(mask)))).alias("bit")).distinct().toArrow()
    bits = np.zeros(1 << MAP_BITS, dtype=bool)
    bits[places.column("bit").to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                code, slot, maybe, words = template(text.as_py())
                for at, hashes, values in spots(code, slot, maybe, words):
                    a, b = _bits(hashes)
                    hit = np.flatnonzero(known[a] & known[b])
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * len(hit), pa.int64()), pa.array(at[hit], pa.int64()), pa.array(hashes[hit].view(np.int64)), pa.array(values(at[hit]))], ["doc_id", "doc_pos", "h", "doc_values"])

    found = id_and_text(docs).filter("doc_id is not null").mapInArrow(run, "doc_id long, doc_pos long, h long, doc_values string")
    sides = parts.join(first.select("item_id", "items"), "item_id").select("item_id", "items", "item_pos", "h", "item_values", "n_windows")
    pairs = F.when(F.col("item_values") == "", F.array().cast("array<struct<item:string,doc:string>>")).otherwise(F.zip_with(F.split("item_values", "\x1f"), F.split("doc_values", "\x1f"), lambda x, y: F.struct(x.alias("item"), y.alias("doc"))))
    matched = found.join(sides, "h").select("doc_id", "item_id", "items", "n_windows", "item_pos", (F.col("doc_pos") - F.col("item_pos")).alias("offset"), pairs.alias("pairs"), F.struct("item_pos", "h", "doc_values").alias("seen"))
    by_offset = matched.groupBy("doc_id", "item_id", "items", "n_windows", "offset").agg(F.collect_set("item_pos").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.collect_set("seen").alias("seen")).filter(_consistent(F.col("pairs")))
    whole = by_offset.groupBy("doc_id", "item_id", "items", "n_windows").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.every(F.forall("pairs", lambda p: p["item"] == p["doc"])).alias("verbatim"), F.flatten(F.collect_list("seen")).alias("seen"))
    held = settle(whole.withColumn("coverage", F.size("places") / F.col("n_windows")).filter(F.col("coverage") >= cover), f"{path}/held")
    # a sibling with the same template may be the one that the document has word for word
    asked = held.filter("not verbatim and size(items) > 1").select("doc_id", "item_id", "seen", F.explode("items").alias("other"))
    seen = asked.select("doc_id", "item_id", "other", F.explode("seen").alias("x")).select("doc_id", "item_id", "other", "x.*")
    values = parts.select(F.col("item_id").alias("other"), "item_pos", "h", "item_values")
    same = seen.join(values, ["other", "item_pos", "h"], "left").groupBy("doc_id", "item_id", "other").agg(F.every(F.coalesce(F.col("item_values") == F.col("doc_values"), F.lit(False))).alias("same"))
    fits = same.filter("same").groupBy("doc_id", "item_id").agg(F.min("other").alias("fits"))
    out = held.join(fits, ["doc_id", "item_id"], "left")
    return out.select("doc_id", F.coalesce("fits", "item_id").alias("item_id"), "items", "n_windows", F.size("places").cast("long").alias("n_matched"), "coverage", (F.col("verbatim") | F.col("fits").isNotNull()).alias("verbatim"))
