import zlib

import numpy as np
import pytest

from quernstone.llm import language_id, quality_gam
from quernstone.llm.queries import QUERIES


def test_language_on_held_out_rows(spark, sf_dir):
    rows = QUERIES["op6_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and held
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, nothing):
    model = language_id.fit(odd)
    got = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert [i for i in got if got[i].lang_pred == "und"] == [2, 3, 6, 9] and got[4].lang_pred == "de" and got[1].lang_pred == "en"
    kept = language_id.keep_known(odd, model)
    assert kept.columns == odd.columns and {2, 3, 6, 9}.isdisjoint(r.doc_id for r in kept.collect())
    empty = language_id.fit(nothing)
    assert empty.languages == [] and {r.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}


def test_filter_returns_sets():
    counts = [(np.array([5, 70]), np.array([100, 50])), (np.array([5, 70]), np.array([100, 50])), (np.array([9, 70]), np.array([100, 50]))]
    model = language_id.LanguageFilter(["a", "b", "c"], counts)
    at = np.array([5, 9, 70], dtype=np.uint64) << np.uint64(64 - language_id.COUNT_BITS)
    assert [x.tolist() for x in model.sets(at)] == [[0b011, 0b100, 0b111]]


def test_quality_on_held_out_labels(spark, sf_dir):
    got = QUERIES["op8_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.85 and all(r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 1), (6, 0), (7, 0), (None, 1), (8, None), (99, 0)], "doc_id long, quality int")
    model = quality_gam.fit(odd, labels)
    got = quality_gam.score(odd, model).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert quality_gam.score(nothing, model).count() == 0
    assert len({r.score for r in quality_gam.score(odd, quality_gam.fit(odd, labels.limit(0))).collect()}) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_learn_what_single_features_cannot(seed):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.train(x, y)
    assert (0, 1) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.9


def test_more_languages_than_a_word_has_bits(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[(k * 7 + j * (k % 5 + 1)) % 26] for j in range(6)) + letters[k % 26] + letters[k // 26]
    rows = [(k, f"{word(k)} {word(k)[::-1]} " * 12, f"l{k:03d}") for k in range(130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert len(model.languages) == 130 and len(model.tables) == 3
    assert sum(got[k] == lang for k, _, lang in rows) >= 125
