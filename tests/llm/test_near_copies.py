import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quernstone.llm import common, simhash


def texts():
    """Near copies of a few texts with single words changed, exact copies, short texts and unrelated ones."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    out = []
    for size, copies in [(200, 60), (60, 12), (400, 5), (12, 4)]:
        base = [word() for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.randrange(1 + size // 40)):
                words[rnd.randrange(size)] = word()
            out.append(" ".join(words))
    out += [" ".join(word() for _ in range(80)) for _ in range(20)] + ["one two", "One  two", "one", "", None, " "]
    rnd.shuffle(out)
    return [(10 * i + 3, t) for i, t in enumerate(out)]


def brute(rows):
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}))
    root = {i: i for i, _ in rows}
    for i, x in sets:
        for j, y in sets:
            if i < j and 5 * len(x & y) >= 4 * len(x | y):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("share", [3, 256])
def test_near_copies_equal_brute_force(spark, folder, monkeypatch, share):
    monkeypatch.setattr(simhash, "SHARE", share)
    rows = texts()
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()}
    assert got == brute(rows)


def test_the_stage_keeps_one_of_the_near_copies(spark, sf_dir):
    rows = texts()
    docs = spark.createDataFrame([*rows, (None, "no id"), (None, "no id")], "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(brute(rows).values())) and kept.count(None) == 2


def mutated(copies, size, every):
    """Copies of one text, each with every so manyth word changed."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(size)]
    return [(k, " ".join(word() if rnd.randrange(every) == 0 else w for w in base)) for k in range(copies)]


def test_copies_that_are_surely_too_far_apart_are_not_compared(spark, folder, monkeypatch):
    rows, compared, seen = mutated(60, 800, 34), simhash._compared, []
    monkeypatch.setattr(simhash, "_compared", lambda pairs, *more: seen.append(pairs.count()) or compared(pairs, *more))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()}
    assert got == brute(rows) and 10 * sum(seen) < 60 * 59 / 2


def test_shingles_are_made_where_the_texts_are(spark, folder, monkeypatch):
    plans, settle = {}, simhash.settle
    monkeypatch.setattr(simhash, "settle", lambda df, path: plans.setdefault(path.rsplit("/", 1)[1], df._jdf.queryExecution().executedPlan().toString()) and settle(df, path))
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    simhash.near_copies(docs, folder)
    assert "Exchange" not in plans["sets"] and "text#" not in plans["met"].split("Exchange")[0]


def test_ids_that_may_be_in(spark):
    ids, others = [None, -5, 0, 7, 1 << 40, *range(1000, 3000)], range(10_000, 20_000)
    test = common.may_be_in(spark.createDataFrame([(i,) for i in ids], "id long"))
    held = {r.id for r in spark.createDataFrame([(i,) for i in [*ids, *others]], "id long").filter(test(F.col("id"))).collect()}
    assert held >= set(ids) and len(held) < len(ids) + 400
    assert not spark.range(9).filter(common.may_be_in(spark.createDataFrame([], "id long"))(F.col("id"))).collect()
