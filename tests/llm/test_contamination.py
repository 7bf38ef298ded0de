from quernstone.llm import template_decontamination


def found(spark, docs, items, path):
    out = template_decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), path)
    return {(r.doc_id, r.item_id, r.verbatim) for r in out.collect()}


def test_siblings_with_other_equal_slots(spark, folder):
    ask = "please work out what is {} plus {} and write it down"
    items = [(1, ask.format(3, 3)), (2, ask.format(3, 4)), (3, ask.format(5, 6))]
    docs = [(1, ask.format(3, 4)), (2, ask.format(5, 6)), (3, ask.format(7, 8)), (4, ask.format(9, 9))]
    got = found(spark, docs, items, folder)
    assert got == {(1, 2, True), (2, 3, True), (3, 2, False), (4, 1, False), (4, 2, False)}


def test_names_at_sentence_beginnings(spark, folder):
    ask = "{0} has 3 apples. {0} buys 5 more. How many apples does {0} have?"
    docs = [(1, "So it goes. " + ask.format("Anna")), (2, "It was late. " + ask.format("Tom")), (3, ask.format("Anna").replace("does Anna", "does Erik"))]
    assert found(spark, docs, [(7, ask.format("Tom"))], folder) == {(1, 7, False), (2, 7, True)}
