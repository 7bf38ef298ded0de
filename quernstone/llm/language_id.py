"""Language identification with language-bitmask n-gram filters.

Training counts letter n-grams for each language, in hashed bins of a fixed number. An n-gram belongs to every
language in which its rate is at least SHARE of its highest rate, if it was seen often enough. A Bloom filter
holds one bit row for each language; the rows lie bit-sliced, so the word at a filter position has the bits of
all languages, and the AND of an n-gram's positions is the set of all languages that contain it. A text's
n-grams give a popcount for each language; those are corrected for the filter's false positives, and the
largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
N = 4
COUNT_BITS = 20
FILTER_BITS = 20
HASHES = 3
SHARE = 0.4
LEAST = 8

_letters: list[np.ndarray] = []


def lowered() -> np.ndarray:
    """For each code point its lower-case letter, or a blank for what is no letter; 2 MB, one for a process."""
    if not _letters:
        out = np.full(0x110000, 32, dtype=np.uint32)
        for i in range(0x32000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _letters.append(out)
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """A 64-bit hash of each n-gram with at most one blank at either end; runs of other characters are one blank."""
    codes = lowered()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    blank = codes == 32
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    codes = codes[keep].astype(np.uint64)
    if len(codes) < N:
        return np.zeros(0, dtype=np.uint64)
    m = len(codes) - N + 1
    h = np.zeros(m, dtype=np.uint64)
    inner = np.zeros(m, dtype=bool)
    for j in range(N):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + m]
        if 0 < j < N - 1:
            inner |= codes[j : j + m] == 32
    h = h[~inner]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class LanguageFilter:
    """The bit-sliced filter, one table of words for each 64 languages. counts: for each language its bins and their occurrences."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = languages
        highest, seen = np.zeros(1 << COUNT_BITS), np.zeros(1 << COUNT_BITS)
        for bins, n in counts:
            highest[bins] = np.maximum(highest[bins], n / max(1, n.sum()))
            seen[bins] += n
        kind = next((k for b, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if len(languages) <= b), np.uint64)
        self.tables = [np.zeros(1 << FILTER_BITS, dtype=kind) for _ in range(-(-len(languages) // 64))]
        fill = np.zeros(len(languages))
        for i, (bins, n) in enumerate(counts):
            member = (n / max(1, n.sum()) >= SHARE * highest[bins]) & (n > 0) & (seen[bins] >= LEAST)
            words, bit = self.tables[i // 64], kind(1 << i % 64)
            for at in self.positions(bins[member].astype(np.uint64)):
                words[at] |= bit
            fill[i] = np.mean(words & bit != 0)
        self.false = fill**HASHES

    @staticmethod
    def positions(bins: np.ndarray) -> list[np.ndarray]:
        a = (bins + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(31)
        b = (a * np.uint64(0x94D049BB133111EB)) >> np.uint64(20) | np.uint64(1)
        return [((a + np.uint64(i) * b) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) for i in range(HASHES)]

    def sets(self, hashes: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the bits of all languages that contain it, by 64 languages."""
        first, *rest = self.positions(hashes >> np.uint64(64 - COUNT_BITS))
        out = []
        for words in self.tables:
            found = words[first]
            for at in rest:
                found = found & words[at]
            out.append(found)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the corrected popcounts; ties go to the first language by name."""
        if not text or not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0
        hashes = grams(text)
        n = len(hashes)
        if n == 0:
            hashes, n = grams(text + " " + text), 1
        sets = self.sets(hashes)
        if len(self.languages) <= 16:
            found = np.bincount(sets[0].astype(np.int64), minlength=1)
            which = np.arange(len(found))
            hits = np.array([found[(which >> i) & 1 == 1].sum() for i in range(len(self.languages))], dtype=float)
        else:
            hits = np.array([np.count_nonzero(sets[i // 64] >> sets[i // 64].dtype.type(i % 64) & sets[i // 64].dtype.type(1)) for i in range(len(self.languages))], dtype=float)
        right = np.clip((hits - n * self.false) / np.maximum(1 - self.false, 1e-9), 0, None)
        best = int(np.argmax(right))
        total = right.sum()
        return self.languages[best], float(right[best] / total) if total > 0 else 0.0


def fit(train: DataFrame) -> LanguageFilter:
    """Learns from all rows of train (text, lang); rows without text or lang are left out.

    What comes to the driver is a count for each language and bin that occurs: at most 2**COUNT_BITS numbers a
    language, whatever the size of the table, sent packed by language and slice of bins.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                table = tables.setdefault(lang.as_py(), np.zeros(1 << COUNT_BITS, dtype=np.int64))
                np.add.at(table, (grams(text.as_py()) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            for k in range(0, len(at), 1 << 16):
                some = at[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(table[some], pa.int64())], ["lang", "bin", "n"])

    rows = train.select("text", "lang").filter("text is not null and lang is not null").mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    slices = rows.groupBy("lang", F.shiftright("bin", 14).alias("slice")).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("counts")).select("lang", F.col("counts.bin").alias("bins"), F.col("counts.n").alias("ns"))
    got = slices.toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {x: [] for x in languages}
    for lang, bins, ns in zip(got.column("lang").to_pylist(), got.column("bins"), got.column("ns"), strict=True):
        parts[lang].append((bins.values.to_numpy(), ns.values.to_numpy()))
    counts = [tuple(np.concatenate(x) for x in zip(*parts[lang], strict=True)) for lang in languages]
    return LanguageFilter(languages, counts)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text; nothing else is read).

    A text that is null or has no letter is `und` with score 0; so is every text if nothing was learned.
    The model goes to the executors as a broadcast value of 2**FILTER_BITS words for each 64 languages, whatever the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [m.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageFilter, least: float = 0.0) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is recognised with a score above `least`.

    Texts that are null, have no letter, or share no n-gram with a learned language go.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch.column(place)]
            yield batch.filter(pa.array([lang != UNKNOWN and score > least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(fold: int = 1, folds: int = 3) -> Column:
    """Whether a document is kept from training."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold
