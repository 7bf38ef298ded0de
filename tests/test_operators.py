"""Operators, sources and sinks on small tables."""

from pyspark.sql import functions as F

from quernstone.functions import json
from quernstone.operators import lookup
from quernstone.session import info
from quernstone.sources import generate, sinks, text
from quernstone.streaming import windows


def test_case_forms_agree_with_chains(spark):
    df = spark.range(-5, 120).select(F.when(F.col("id") % 17 != 0, F.col("id")).alias("x"))
    bounds, values = list(range(0, 100, 10)), [f"v{k}" for k in range(10)]
    chain = F.lit("else")
    for b, v in reversed(list(zip(bounds, values))):
        chain = F.when(F.col("x") < b, v).otherwise(chain)
    keys = {k: k * 2 for k in range(0, 100, 7)}
    equal = F.lit(-1)
    for k, v in keys.items():
        equal = F.when(F.col("x") == k, v).otherwise(equal)
    got = df.select((lookup.case_below(F.col("x"), bounds, values, "else") == chain).alias("a"), (lookup.case_equal(F.col("x"), keys, -1) == equal).alias("b")).collect()
    assert all(r.a and r.b for r in got)


def test_lists_and_groups(spark, monkeypatch):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("g"))
    short = lookup.is_in(df, "id", [1, 2, None, 500]).count()
    monkeypatch.setattr(lookup, "LITERALS", 1)
    assert short == lookup.is_in(df, "id", [1, 2, None, 500]).count() == 2
    assert lookup.top_rows(df, ["g"], [F.desc("id")], 3).count() == 21
    assert lookup.not_in(df, "id", df.filter("id < 40"), "id").count() == 60
    assert lookup.not_in(df, "id", df.select(F.expr("nullif(id, 3)").alias("id")), "id").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|a|2.50|\n2|b|3.75|\n")
    assert [tuple(r) for r in text.read_delimited(spark, f"file://{tmp_path}/t.tbl", "id int, s string, n decimal(15,2)").selectExpr("id", "s", "cast(n as string)").collect()] == [(1, "a", "2.50"), (2, "b", "3.75")]
    df = generate.bench_data(spark, 1000)
    sinks.write_ranges(df, f"file://{tmp_path}/ranges", "grp", [25, 50, 75])
    back = spark.read.parquet(f"file://{tmp_path}/ranges")
    assert [r["count"] for r in back.groupBy("part").count().orderBy("part").collect()] == [250] * 4
    assert "PartitionFilters: [isnotnull(part" in back.filter("part = 2")._jdf.queryExecution().toString()
    changed = sinks.updated(df, F.col("id") == 5, {"val1": F.lit(7)})
    assert changed.filter("id = 5").first().val1 == 7 and changed.dtypes == df.dtypes
    moved = sinks.updated_from(df, df.groupBy("grp").agg(F.max("val2").alias("m")), "grp", {"val1": "m"})
    assert moved.columns == df.columns and moved.count() == 1000
    assert generate.wide(spark, 100, 200).filter("c0091 is not null").count() == 20 and generate.join_left(spark, 10).count() == 10
    assert generate.date_data(spark, 10).schema["ts"].dataType.simpleString() == "timestamp_ntz" and generate.join_right(spark, 5).count() == 5


def test_json(spark):
    docs = ["", "{}", '{"a": 42}', "[1]", "3", '"x"', "{a}", '{"a":', "null", None, ' {"b": {"a": 1}}']
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    got = df.select(json.is_json(F.col("d")), json.is_json(F.col("d"), "object"), json.is_json(F.col("d"), "array"), json.is_json(F.col("d"), "scalar"), json.contains(F.col("d"), {"a": 42}), json.has_key(F.col("d"), "a")).collect()
    assert [r[0] for r in got] == [False, True, True, True, True, True, False, False, True, None, True]
    assert [r[1] for r in got] == [False, True, True, False, False, False, False, False, False, None, True]
    assert [i for i, r in enumerate(got) if r[2]] == [3] and [i for i, r in enumerate(got) if r[3]] == [4, 5, 8]
    assert [i for i, r in enumerate(got) if r[4]] == [2] == [i for i, r in enumerate(got) if r[5]]


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(2).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = windows.tumbling(stream, "1 day", late="60 days").writeStream.outputMode("complete").format("memory").queryName("tumbling").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, windows.tumbling(events, "1 day").collect()))
    assert windows.sessions(events, "6 hours").agg(F.sum("n")).first()[0] == events.count()


def test_info(spark):
    assert info(spark)["spark.sql.adaptive.enabled"] == "true"
