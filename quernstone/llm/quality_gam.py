"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into at most BINS bins. Boosting goes round the features, one shallow tree of one feature at
a time, and adds the tree's leaf values into that feature's lookup table; when the single features are done, the
pairs whose four-quadrant trees explain most of what is left get tables of their own in the same way. A score is
the sigmoid of the sum of one entry for each feature and pair: additions over bins, done for whole batches.

The model is fitted on the driver from at most SAMPLE labelled rows' features (a documented bound); texts do not
come to the driver. Which rows: those with the smallest hash of their id, so the sample has no order of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import id_and_text

SAMPLE = 20_000
BINS = 32
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.1
LEAST_HESSIAN = 2.0
FEATURES = ["log_chars", "log_words", "mean_word", "long_words", "upper", "digit", "symbol", "mark", "comma_stop", "line_words", "line_repeats", "word_variety", "top_word", "non_ascii", "shout", "bar"]

#: Byte classes: 1 upper case, 2 digit, 3 comma or stop, 4 exclamation or question mark, 5 bar, 6 white space, 7 other symbol, 8 beyond ASCII, 0 the rest.
_class = np.zeros(256, dtype=np.uint8)
_class[33:127] = 7
_class[65:91], _class[97:123], _class[48:58] = 1, 0, 2
_class[[44, 46]], _class[[33, 63]], _class[124] = 3, 4, 5
_class[[9, 10, 11, 12, 13, 32]] = 6
_class[128:] = 8


def features(text: str) -> list[float]:
    """What the model sees of a whole text; zeros for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    data = text.encode()
    n = len(data)
    count = np.bincount(_class[np.frombuffer(data, dtype=np.uint8)], minlength=9) / n
    words = data.split()
    w = max(1, len(words))
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lines = [x for x in data.split(b"\n") if x]
    long = sum(1 for x in seen if len(x) > 14)
    return [
        np.log1p(n),
        np.log1p(len(words)),
        sum(map(len, words)) / w,
        long / max(1, len(seen)),
        count[1],
        count[2],
        count[7],
        count[4],
        count[3],
        w / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        len(seen) / w,
        max(seen.values(), default=0) / w,
        count[8],
        data.count(b"!!") / w,
        count[5],
    ]


class QualityModel:
    def __init__(self, edges: list[np.ndarray], start: float, tables: np.ndarray, pairs: list[tuple[int, int]], pair_tables: np.ndarray) -> None:
        self.edges, self.start, self.tables, self.pairs, self.pair_tables = edges, start, tables, pairs, pair_tables

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, for a matrix of features."""
        b = self.bins(x)
        total = np.full(len(x), self.start)
        for j in range(b.shape[1]):
            total += self.tables[j][b[:, j]]
        for k, (i, j) in enumerate(self.pairs):
            total += self.pair_tables[k][b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h >= LEAST_HESSIAN, g * g / (h + 1.0), -np.inf)


def _best_cut(g: np.ndarray, h: np.ndarray) -> int:
    """The best place to part the bins in two, or 0 if none helps."""
    if len(g) < 2:
        return 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
    k = int(np.argmax(gain))
    return k + 1 if gain[k] > _gain(g.sum(), h.sum()) else 0


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of depth two."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    cut = _best_cut(g, h)
    if cut:
        for part in (slice(0, cut), slice(cut, len(g))):
            sub = _best_cut(g[part], h[part])
            a, b = part.start, part.stop
            for lo, hi in ((a, a + sub), (a + sub, b)):
                if hi > lo:
                    out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best four-quadrant tree of two features' bins, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a_g, a_h = cg[:-1, :-1], ch[:-1, :-1]
    top_g, top_h, left_g, left_h = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    quads = [(a_g, a_h), (top_g - a_g, top_h - a_h), (left_g - a_g, left_h - a_h), (tg - top_g - left_g + a_g, th - top_h - left_h + a_h)]
    gain = sum(x * x / (y + 1.0) for x, y in quads)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for (x, y), (r, c) in zip(quads, ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), strict=True):
        out[r, c] = _leaf(x[i, j], y[i, j])
    return out, float(gain[i, j])


def train(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Cyclic boosting over all rows of x. Without rows, or with labels all alike, the score is constant."""
    n, m = x.shape
    rate = (y.sum() + 0.5) / (n + 1.0)
    start = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    model = QualityModel(edges, start, np.zeros((m, BINS)), [], np.zeros((0, BINS, BINS)))
    if n == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(n, start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(m):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, j], g, BINS), np.bincount(b[:, j], h, BINS))
            model.tables[j] += step
            total += step[b[:, j]]
    g, h = slopes()
    found = []
    for i in range(m):
        for j in range(i + 1, m):
            at = b[:, i] * BINS + b[:, j]
            found.append((_pair_tree(np.bincount(at, g, BINS * BINS).reshape(BINS, BINS), np.bincount(at, h, BINS * BINS).reshape(BINS, BINS))[1], i, j))
    model.pairs = [(i, j) for _, i, j in sorted(found, reverse=True)[:PAIRS]]
    model.pair_tables = np.zeros((len(model.pairs), BINS, BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            at = b[:, i] * BINS + b[:, j]
            step = RATE * _pair_tree(np.bincount(at, g, BINS * BINS).reshape(BINS, BINS), np.bincount(at, h, BINS * BINS).reshape(BINS, BINS))[0]
            model.pair_tables[k] += step
            total += step[b[:, i], b[:, j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Learns from labels (doc_id, quality) of at most `sample` rows; null labels and unknown documents are left out."""
    chosen = labels.select("doc_id", F.col("quality").cast("double").alias("label")).filter("doc_id is not null and label is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    texts = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = texts.mapInArrow(run, "doc_id long, label double, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got.x.tolist(), dtype=float).reshape(len(got), len(FEATURES))
    order = np.lexsort([*x.T, got.label.to_numpy(), got.doc_id.to_numpy()])
    return train(x[order], got.label.to_numpy()[order])


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for each row of docs (doc_id, text). Null and empty texts are scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)], dtype=float).reshape(batch.num_rows, len(FEATURES))
            p = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(fold: int = 0, folds: int = 5) -> Column:
    """Whether a document's label is kept from training."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold
