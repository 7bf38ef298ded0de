"""The rules that the engine must keep where its functions could be used wrongly."""

import re

import pytest
from pyspark.sql import functions as F

from quernstone.functions.regex import RegexError, to_java
from quernstone.functions.scalar import half_even, int_div, interval_key, masked_shift, overflows, strict_float, three_way


def one(spark, expression):
    return spark.sql(f"select {expression} as x").first().x


@pytest.mark.parametrize("expression, want", [
    (int_div("-7", "2", "int"), -3), ("-7 % 3", -1), ("cast(-2147483648 as int) % -1", 0), (half_even("2.5D", "int"), 2), (half_even("3.5D", "int"), 4), (half_even("-2.5D", "bigint"), -2),
    (masked_shift("1", "33", 32), 2), (masked_shift("1L", "65", 64), 2), (masked_shift("-8", "1", 32, left=False), -4), (three_way("double('NaN')", "1D"), 1), (three_way("double('NaN')", "double('NaN')"), 0),
    ("2 in (1, null)", None), ("2 not in (1, null)", None), ("1 in (1, null)", True), ("'aXb' like 'a_b'", True), ("'a\\nb' like 'a_b'", True),
    (f"{interval_key('1', '0', '0')} = {interval_key('0', '30', '0')}", True), (f"{interval_key('0', '1', '0')} = {interval_key('0', '0', '86400000000')}", True), (strict_float("1e300D * 10", "1e300D", "10D"), 1e301)])
def test_value(spark, expression, want):
    assert one(spark, expression) == want


@pytest.mark.parametrize("expression", ["2147483647 + 1", "abs(cast(-2147483648 as int))", "cast(3000000000 as int)", "1 div 0", int_div("cast(-2147483648 as int)", "-1", "int"), half_even("double('NaN')", "int"), strict_float("1e308D * 10", "1e308D", "10D"), "cast(200 as tinyint) + 1"])
def test_error(spark, expression):
    with pytest.raises(Exception):
        one(spark, expression)


@pytest.mark.parametrize("pattern, flags, text, want", [
    ("a.b", "", "a\nb", True), ("a$", "", "a\n", False), ("^.$", "", "\n", True), ("^[[:alpha:]]$", "", "x", True), ("^[[:alpha:]]$", "", ":", False), (r"\mcat\M", "", "a cat.", True), (r"\mcat\M", "", "concat", False),
    (r"[[:<:]]cat[[:>:]]", "", "cat", True), ("ABC", "i", "xabcx", True), ("^b", "n", "a\nb", True), ("^b", "", "a\nb", False), (r"(?=(a))(b|a)\1", "", "aa", True), (r"[^[:space:]]+", "", " \t", False), ("***=a.b", "", "a.b", True), ("***=a.b", "", "axb", False),
    (r"a{2,3}?", "", "aa", True), (r"\yfoo\y", "", "foo", True), ("[]a]", "", "]", True), ("(?i)abc", "", "ABC", True), ("a b", "x", "ab", True), (r"é", "i", "É", True), (r"[a&&b]", "", "&", True)])
def test_regex(spark, pattern, flags, text, want):
    assert spark.createDataFrame([(text,)], "s string").selectExpr("rlike(s, r'" + to_java(pattern, flags).replace("'", "\\'") + "') as x").first().x is want


@pytest.mark.parametrize("pattern", ["(a", "a)", "[a", "[[:nope:]]", "a{256}", "*a", r"(a)(?=\1)", r"\2(a)", r"^*", "a\\"])
def test_regex_refused(pattern):
    with pytest.raises(RegexError):
        to_java(pattern)


def test_only_entry_guards_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent
    for f in (root / "quernstone").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"quernstone\.llm|corpus_pipeline", f.read_text()), f


@pytest.mark.parametrize(
    ("pattern", "flags", "text", "want"),
    [("^b", "", "a\nb", False), ("^b", "n", "a\nb", True), ("^b", "w", "a\nb", True), ("^b", "p", "a\nb", False), ("a.b", "", "a\nb", True), ("a.b", "p", "a\nb", False), ("a.b", "w", "a\nb", True), ("a[^x]b", "n", "a\nb", False), ("a[^x]b", "", "a\nb", True), ("(?q)a.b", "", "a.b", True), ("(?q)a.b", "", "axb", False), ("(a)(b)(c)(d)(e)(f)(g)(h)(i)(j)\\10", "", "abcdefghijj", True)],
)
def test_regex_flags(spark, pattern, flags, text, want):
    from quernstone.functions.regex import to_java

    assert spark.createDataFrame([(text,)], "s string").select(F.col("s").rlike(to_java(pattern, flags))).first()[0] is want


def test_json_types_and_keys(spark):
    from quernstone.functions.json import contains, is_json

    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        rows = ['{"a": 42}', '{"a": "42"}', '{"a": 42.0}', '{"a": true}', '{"a": null}', '{"b": 1}', '{"a": 1, "a": 2}', '{"x": {"a": 1, "a": 2}}', "[1]", "nope", None]
        df = spark.createDataFrame([(r,) for r in rows], "s string")
        out = df.select("s", contains(F.col("s"), {"a": 42}).alias("n"), contains(F.col("s"), {"a": "42"}).alias("t"), is_json(F.col("s")).alias("j"), is_json(F.col("s"), unique=True).alias("u")).collect()
        assert [r.n for r in out] == [True, False, True, False, False, False, False, False, False, False, None]
        assert [r.t for r in out] == [False, True, *[False] * 8, None]
        assert [r.j for r in out] == [*[True] * 9, False, None]
        assert [r.u for r in out] == [*[True] * 6, False, False, True, False, None]
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", before)


def test_overflow_is_told_by_bounds(spark):
    """As Python's numbers tell it, next to every bound; nothing is caught."""
    tried = [(sign, n) for sign, found in (("+", (0, 1, -1, 807, -32768, 32767)), ("-", (0, 1, -1, 807, -32768, 32767)), ("*", (0, 1, -1, 2, -2, 3, -7, 32767, -32768))) for n in found]
    df = spark.range(-32768, 32768).selectExpr("cast(id as smallint) AS x").selectExpr("x", *(f"{overflows('x', sign, n, 'smallint')} AS t{k}" for k, (sign, n) in enumerate(tried)))
    count = {"+": int.__add__, "-": int.__sub__, "*": int.__mul__}
    got = df.toPandas()
    for k, (sign, n) in enumerate(tried):
        assert [bool(t) for t in got[f"t{k}"]] == [not -32768 <= count[sign](x, n) <= 32767 for x in got["x"].tolist()], (sign, n)
    assert one(spark, overflows("cast(null as int)", "*", 5, "int")) is None
