import base64
import hashlib
import random

import corpus_pipeline
import pytest

from quernstone.llm import template_decontamination, warc
from quernstone.llm.common import shared_dir, table
from quernstone.llm.queries import QUERIES


def test_items_are_found(spark, sf_dir):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_template_decontamination"](spark, sf_dir).collect()}
    items = table(spark, sf_dir, "benchmark").collect()
    want = {(d.doc_id, i.item_id) for d in table(spark, sf_dir, "documents").collect() for i in items if i.text in d.text}
    assert want <= got and len(got - want) <= len(want) // 10


def test_slots(spark, folder):
    question = "In total {} bought {} kg of red apples from {} and paid {} dollars to {} yesterday evening."
    docs = [(1, "Once. " + question.format("Anna", 12, "Bob", 30, "Bob") + " Then home."), (2, "so " + question.format("Carla", 15, "Dave", 99, "Dave")), (3, question.format("Carla", 15, "Dave", 99, "Erik")), (4, None), (5, ""), (None, question), (6, "in total nothing")]
    items = [(7, question.format("Anna", 12, "Bob", 30, "Bob")), (9, question.format("Zoe", 1, "Yan", 3, "Yan")), (8, None), (None, "a b c d e f"), (10, "too short")]
    run = lambda d, b, at: template_decontamination.contaminated(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(b, "item_id long, text string"), f"{folder}/{at}").collect()
    assert {(r.doc_id, r.item_id, r.verbatim) for r in run(docs, items, "a")} == {(1, 7, True), (2, 7, False)}
    assert all(r["items"] == [7, 9] for r in run(docs, items, "b"))
    assert run(docs[:2], [], "c") == [] == run([], items, "d")


def brute_index(pages):
    first = {}
    for i, _, html in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(html or "", i)
    return {i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))) for i, _, h in pages}


def test_archives_round_trip(spark, folder):
    big = "".join(random.choice("abc\r\n ") for _ in range(200_000)) * 90
    pages = [(3, "http://www.A.example/x?q=1#f", "<p>é</p>"), (1, "http://a.example/x?q=1", "<p>é</p>"), (2, None, None), (4, "bad\r\nurl ü", ""), (5, "http://[", "WARC/1.1\r\n\r\n\r\nContent-Length: 9"), (6, "https://b.example:444/", big), (7, "https://b.example:444/", big)]
    got = warc.archive_and_index(spark.createDataFrame(pages, "page_id long, url string, html string"), folder).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute_index(pages)
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and got[[r.page_id for r in got].index(1)].url_key == "example,a)/x?q=1"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_index(empty, folder + "-e").count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 8, 13])
def test_loser_tree(k):
    runs = [sorted(random.choices(range(50), k=random.randrange(30))) for _ in range(k)]
    assert [x[0] for x in warc.LoserTree([iter([(v,) for v in r]) for r in runs])] == sorted(sum(runs, []))


def test_least_payload(spark, folder):
    pages = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = warc.archive_and_index(spark.createDataFrame(pages, "page_id long, url string, html string"), folder, least=5)
    assert {r.page_id: r.record_type for r in got.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_pipeline(spark, sf_dir):
    base, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    columns, counts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100 and counts[-1] == counts[-2]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "decontamination", "encoding"]


def test_stages_take_odd_rows(spark, sf_dir, odd):
    docs = odd.select("doc_id", "text", "lang", "source", odd.doc_id.alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() > 0
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_does_not_multiply_repeated_rows(spark, sf_dir):
    t = " ".join(f"word{i}" for i in range(46))
    rows = [(1, t), (1, t), (2, "quite another text of a few words"), (3, t + " end"), (4, "one"), (4, "two " + t[::-1])]
    docs = spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    counts = []
    for _, stage in corpus_pipeline.STAGES[1:]:
        base = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(base)
        docs = spark.read.parquet(base)
        counts.append(docs.count())
        if "text" in docs.columns:
            assert [r.text for r in docs.collect() if r.doc_id == 1] == [t]
    assert counts == [4, 4, 4, 4]
