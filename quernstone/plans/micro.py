"""Micro-operator corpus: one small query for each operator, over fixtures derived from the driver's tables."""

from __future__ import annotations

from quernstone.functions.regex import to_java
from quernstone.plans.suite import FIXTURES, Query

_row = "l_orderkey * 8 + l_linenumber"
FIXTURES |= {
    "join_left": f"SELECT cast({_row} as bigint) AS id, cast(l_orderkey as bigint) AS key1, cast(l_partkey % 50 as bigint) AS key2, cast((l_partkey * 37 + l_linenumber * 11) % 10000 as int) AS val FROM lineitem",
    "join_right": "SELECT cast(o_orderkey as bigint) AS id, cast(o_orderkey * 3 % 20000 as bigint) AS key1, cast(o_custkey % 50 as bigint) AS key2, cast(o_custkey * 53 % 10000 as int) AS val FROM orders",
    "bench_data": f"""SELECT cast({_row} as bigint) AS id, cast(l_partkey % 100 as int) AS grp, cast((l_partkey * 37 + l_linenumber) % 10000 as int) AS val1, cast((l_suppkey * 91 + l_orderkey) % 10000 as int) AS val2,
        cast(l_orderkey * 13 % 10000 as int) AS val3, cast(l_quantity * 100 as int) AS val4, cast(l_linenumber * 1000 as int) AS val5, concat('row_', cast({_row} as string)) AS txt FROM lineitem""",
    "date_data": "SELECT cast(o_orderkey as bigint) AS id, cast(o_orderdate as date) AS d, o_orderdate AS ts, cast(o_custkey * 7 % 1000 as int) AS val FROM orders",
    "text_data": """SELECT cast(o_orderkey as bigint) AS id, concat('prefix_', cast(o_orderkey % 100 as string)) AS grp_text, md5(cast(o_orderkey as string)) AS hash_text,
        repeat('x', cast(o_orderkey % 50 + 1 as int)) AS varlen_text, concat('word_', cast(o_orderkey % 10000 as string)) AS word FROM orders""",
    "text_long": """SELECT cast(o_orderkey as bigint) AS id, concat(md5(cast(o_orderkey as string)), md5(cast(o_orderkey + 1 as string)), md5(cast(o_orderkey * 7 as string)), md5(cast(o_custkey as string)),
        md5(cast(o_custkey * 3 as string)), md5(cast(o_orderkey * 11 as string)), md5(cast(o_orderkey * 13 as string)), md5(cast(o_custkey * 17 as string)), md5(cast(o_orderkey * 19 as string)),
        md5(cast(o_orderkey * 23 as string)), md5(cast(o_custkey * 29 as string)), md5(cast(o_orderkey * 31 as string)), repeat('z', cast(o_orderkey % 200 as int))) AS long_text FROM orders""",
    "jsonb_data": """SELECT cast(o_orderkey as bigint) AS id, concat('{"a": ', cast(o_orderkey % 1000 as string), ', "b": "', md5(cast(o_orderkey as string)), '", "c": ', cast(o_orderkey as string), '.5}') AS doc,
        concat('{"g": ', cast(o_orderkey % 50 as string), '}') AS grp_jsonb FROM orders""",
    "json_text": """SELECT cast(o_orderkey as bigint) AS id, cast(o_orderkey % 3 as int) AS tier, CASE WHEN o_orderkey % 3 = 0 THEN concat('{"id": ', cast(o_orderkey as string), ', "active": true}')
        WHEN o_orderkey % 3 = 1 THEN concat('{"id": ', cast(o_orderkey as string), ', "active": false, "tags": ["a", "b"], "n": {"x": 1}}')
        ELSE concat('{"id": ', cast(o_orderkey as string), ', "active": true, "body": "', repeat('y', 80), '", "list": [1, 2, 3]}') END AS doc FROM orders""",
    "numeric_data": """SELECT cast(l_orderkey as bigint) AS id, cast(l_extendedprice as decimal(15,2)) AS val1, cast(l_discount as decimal(4,2)) AS val2, cast(l_linenumber as decimal(6,0)) AS grp_num FROM lineitem""",
    "array_data": f"SELECT cast({_row} as bigint) AS id, array(cast(l_partkey % 50 as int), cast(l_suppkey % 50 as int), cast(l_orderkey % 50 as int), cast(l_linenumber as int)) AS tags FROM lineitem",
    "part_data": f"SELECT cast({_row} as bigint) AS id, cast(l_partkey % 100 as int) AS grp, cast(l_quantity as int) AS val FROM lineitem",
    "ultra_wide": "SELECT cast(l_orderkey as bigint) AS id, cast(l_partkey % 200 as int) AS grp, " + ", ".join(f"cast((l_partkey * {k + 3} + l_suppkey * {2 * k + 1} + l_linenumber) % 1000 as int) AS c{k:02d}" for k in range(1, 21)) + " FROM lineitem",
}
for _n in (100, 300, 1000):
    FIXTURES[f"wide_{_n}"] = "SELECT cast(l_orderkey as bigint) AS id, cast(l_partkey % 50 as int) AS grp, " + ", ".join(f"CASE WHEN (l_orderkey * 7919 + {k}) % 10 = 0 THEN cast((l_partkey + {k}) % 1000 as int) END AS c{k:04d}" for k in range(1, _n + 1)) + " FROM lineitem"
    FIXTURES[f"rle_grp_{_n}"] = "SELECT cast(l_partkey % 50 as int) AS grp, " + ", ".join(f"cast((l_partkey + l_suppkey * {k}) % 1000 as int) AS c{k:04d}" for k in range(1, _n + 1)) + " FROM lineitem"
    _kinds = ("cast(l_orderkey + {k} as string)", "cast((l_partkey + {k}) % 100 as smallint)", "(l_partkey + {k}) % 2 = 0", "cast((l_suppkey + {k}) % 97 as double)", "cast(l_orderkey * {k} as bigint)", "cast((l_partkey * {k}) % 1000 as int)")
    FIXTURES[f"rle_rnd_{_n}"] = "SELECT cast(l_partkey % 50 as int) AS grp, " + ", ".join(f"{_kinds[k % 6].format(k=k)} AS c{k:04d}" for k in range(1, _n + 1)).replace("c0000", "c") + " FROM lineitem"


def _plus(*numbers: int) -> str:
    return "+".join(f"c{k:04d}" for k in numbers)


def _count(table: str, where: str, oracle: str | None = None) -> Query:
    return Query(f"SELECT count(*) AS n FROM {table} WHERE {where}", oracle and f"SELECT count(*) AS n FROM {table} WHERE {oracle}")


def _regex(table: str, column: str, pattern: str, negated: bool = False, flags: str = "") -> Query:
    """A POSIX-style pattern: translated for the engine; these patterns mean the same to the oracle."""
    no = "NOT " if negated else ""
    java = to_java(pattern, flags).replace("\\", "\\\\").replace("'", "\\'")
    return _count(table, f"{no}regexp_like({column}, '{java}')", f"{no}regexp_matches({column}, '{'(?i)' if 'i' in flags else ''}{pattern}')")


def _case(n: int, branch: str, other: int | str, head: str = "CASE", **more: str) -> Query:
    return Query(f"SELECT ISUM({head} {' '.join(branch.format(i=i, n=n, lo=i * 10000 // n, hi=(i + 1) * 10000 // n, then=i + 1, up=n - i) for i in range(n))} ELSE {other} END) AS s FROM {more.get('table', 'bench_data')}")


def _in(n: int, null: bool = False) -> Query:
    return _count("bench_data", f"val1 + 0 IN ({', '.join(str(i * 2) for i in range(n))}{', NULL' if null else ''})")


_thirty = " ".join(f"WHEN ts >= cast('{1995 + i // 5}-{1 + 2 * (i % 5):02d}-01' as timestamp_ntz) AND ts < cast('{1995 + i // 5}-{3 + 2 * (i % 5):02d}-01' as timestamp_ntz) THEN ts + INTERVAL '{i + 1}' DAY" for i in range(30))
_bools = " OR ".join(f"(val > {100 * k} AND val < {10000 - 100 * k} AND key1 > {10 * k} AND key2 < {50 - k} AND id % {k + 2} = 0)" for k in range(1, 5))
_nested = "CASE WHEN val1 >= 0 AND val1 < 1000 THEN CASE WHEN val2 < 1000 THEN CASE val3 % 5 WHEN 1 THEN 100 WHEN 2 THEN 200 WHEN 3 THEN 300 WHEN 4 THEN 400 ELSE -1 END WHEN val2 < 2000 THEN 10 ELSE 20 END WHEN val1 < 5000 THEN CASE WHEN val2 < 5000 THEN 30 ELSE 40 END ELSE 50 END"

SUITE: dict[str, Query] = {
    "sum_int": Query("SELECT ISUM(val1) AS s FROM bench_data"),
    "count_star": Query("SELECT count(*) AS n FROM bench_data"),
    "groupby_5agg": Query("SELECT grp, count(*) AS n, ISUM(val1) AS s, DAVG(val1) AS a, min(val1) AS lo, max(val1) AS hi FROM bench_data GROUP BY grp"),
    "groupby_many_groups": Query("SELECT key1, ISUM(val) AS s, count(*) AS n, DAVG(val) AS a FROM join_left GROUP BY key1"),
    "count_distinct": Query("SELECT count(DISTINCT key1) AS n FROM join_left"),
    "hashjoin_single": Query("SELECT count(*) AS n, ISUM(l.val + r.val) AS s FROM join_left l JOIN join_right r ON l.key1 = r.key1"),
    "hashjoin_composite": Query("SELECT count(*) AS n, ISUM(l.val) AS s FROM join_left l JOIN join_right r ON l.key1 = r.key1 AND l.key2 = r.key2"),
    "hashjoin_filter": Query("SELECT count(*) AS n, ISUM(l.val) AS s FROM join_left l JOIN join_right r ON l.key1 = r.key1 WHERE l.val + r.val > 10000 AND l.val * 2 < 15000"),
    "hashjoin_groupby": Query("SELECT l.key1 % 1000 AS bucket, count(*) AS n, ISUM(l.val + r.val) AS s, DAVG(l.val) AS a FROM join_left l JOIN join_right r ON l.key1 = r.key1 GROUP BY l.key1 % 1000"),
    "left_join": Query("SELECT count(*) AS n, ISUM(coalesce(r.val, 0)) AS s FROM join_left l LEFT JOIN join_right r ON l.key1 = r.key1"),
    "right_join": Query("SELECT count(*) AS n, ISUM(coalesce(l.val, 0)) AS s FROM (SELECT * FROM join_left) l RIGHT JOIN join_right r ON l.key1 = r.key1"),
    "full_outer_join": Query("SELECT count(*) AS n, ISUM(coalesce(l.val, 0) + coalesce(r.val, 0)) AS s FROM (SELECT * FROM join_left) l FULL OUTER JOIN (SELECT * FROM join_right) r ON l.key1 = r.key1"),
    "exists_semi": Query("SELECT count(*) AS n FROM join_left l WHERE EXISTS (SELECT 1 FROM join_right r WHERE r.key1 = l.key1 AND r.val > 5000)"),
    "not_exists_anti": Query("SELECT count(*) AS n FROM join_left l WHERE NOT EXISTS (SELECT 1 FROM join_right r WHERE r.key1 = l.key1)"),
    "in_subquery": Query("SELECT count(*) AS n FROM join_left WHERE key1 IN (SELECT key1 FROM join_right WHERE val > 8000)"),
    "set_intersect": Query("SELECT key1 FROM join_left INTERSECT SELECT key1 FROM join_right"),
    "set_intersect_columns": Query("SELECT key1, key2 FROM join_left INTERSECT SELECT key1, key2 FROM join_right"),
    "set_except": Query("SELECT key1 FROM join_left EXCEPT SELECT key1 FROM join_right"),
    "set_union_all": Query("SELECT ISUM(val) AS s FROM (SELECT val FROM join_left UNION ALL SELECT val FROM join_right) t"),
    "case_simple": Query("SELECT ISUM(CASE WHEN val > 5000 THEN val ELSE 0 END) AS s FROM join_left"),
    "case_searched_4way": Query("SELECT ISUM(CASE WHEN val < 1000 THEN 1 WHEN val < 5000 THEN 2 WHEN val < 9000 THEN 3 ELSE 4 END) AS s FROM join_left"),
    "coalesce_nullif": Query("SELECT ISUM(coalesce(nullif(val, 0), -1)) AS s FROM join_left"),
    "bool_and_or": _count("join_left", "(val > 1000 AND val < 9000) OR (key1 > 100 AND key2 < 40)"),
    "arith_expr": Query("SELECT ISUM(val + key1 * 3 - key2) AS s FROM join_left"),
    "scalar_subquery": Query("SELECT ISUM(val) AS s FROM join_left WHERE key1 < (SELECT avg(key1) FROM join_right)"),
    "correlated_subquery": Query("SELECT count(*) AS n FROM (SELECT DISTINCT key1 FROM join_left) d WHERE (SELECT sum(val) FROM join_right r WHERE r.key1 = d.key1) > 5000"),
    # the engine numbers a lateral subquery's rows as they arrive, not by its ORDER BY, so they are ranked here
    "lateral_top3": Query("SELECT grp, val1 AS top_val FROM (SELECT grp, val1, row_number() OVER (PARTITION BY grp ORDER BY val1 DESC) AS place FROM bench_data WHERE grp IS NOT NULL) t WHERE place <= 3",
        "SELECT d.grp, lat.top_val FROM (SELECT DISTINCT grp FROM bench_data) d, LATERAL (SELECT val1 AS top_val FROM bench_data b WHERE b.grp = d.grp ORDER BY val1 DESC LIMIT 3) lat"),
    "lateral_aggregate": Query("SELECT c_custkey, t.n, t.s FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') t ON true"),
    "date_extract": Query("SELECT extract(year FROM d) AS yr, count(*) AS n, ISUM(val) AS s FROM date_data GROUP BY extract(year FROM d)"),
    "timestamp_trunc": Query("SELECT cast(date_trunc('month', ts) as timestamp_ntz) AS mo, count(*) AS n FROM date_data GROUP BY date_trunc('month', ts)"),
    "interval_arith": _count("date_data", "ts + INTERVAL '30' DAY > cast('1998-06-01' as timestamp_ntz) AND ts - INTERVAL '10' DAY < cast('1999-03-01' as timestamp_ntz)"),
    "timestamp_diff": Query("SELECT cast(sum((unix_micros(cast(ts as timestamp)) - 788918400000000) / 1000000) as double) AS s FROM date_data", "SELECT cast(sum(epoch(ts - timestamp '1995-01-01')) as double) AS s FROM date_data"),
    "text_eq_filter": _count("text_data", "grp_text = 'prefix_42'"),
    "text_ne": _count("text_data", "grp_text <> 'prefix_42'"),
    "text_lt": _count("text_data", "grp_text < 'prefix_50'"),
    "text_sort": Query("SELECT grp_text FROM text_data ORDER BY grp_text LIMIT 10"),
    "text_concat_agg": Query("SELECT grp_text, listagg(word, ',') WITHIN GROUP (ORDER BY word) AS words FROM text_data GROUP BY grp_text", "SELECT grp_text, string_agg(word, ',' ORDER BY word) AS words FROM text_data GROUP BY grp_text"),
    "text_length_expr": Query("SELECT ISUM(char_length(varlen_text) + char_length(word)) AS s FROM text_data"),
    **{f"like_{k}": _count("text_data", w) for k, w in {
        "word_prefix": "word LIKE 'word_1%'", "prefix": "hash_text LIKE 'c4ca%'", "suffix": "hash_text LIKE '%ff'", "interior": "hash_text LIKE '%abc%'", "exact": "grp_text LIKE 'prefix_42'", "not_prefix": "hash_text NOT LIKE 'c4ca%'", "not_interior": "hash_text NOT LIKE '%abc%'",
        "under_prefix": "hash_text LIKE 'c4c_4%'", "under_mid": "hash_text LIKE '%a_c%'", "under_only": "grp_text LIKE 'prefix___'", "pct_under_mix": "hash_text LIKE '_4%a_b%'", "multi": "hash_text LIKE '%a%b%'", "3wild": "hash_text LIKE '%a%b%c%'"}.items()},
    **{f"ilike_{k}": _count("text_data", w) for k, w in {"prefix": "hash_text ILIKE 'C4CA%'", "interior": "hash_text ILIKE '%ABC%'", "suffix": "hash_text ILIKE '%FF'", "exact": "grp_text ILIKE 'PREFIX_42'", "not_interior": "hash_text NOT ILIKE '%ABC%'"}.items()},
    "regex_anchor": _regex("text_data", "hash_text", "^[0-9a-f]{4}"),
    "regex_mid": _regex("text_data", "hash_text", "[0-9]{3}[a-f]{3}"),
    "regex_neg": _regex("text_data", "hash_text", "^[0-9]", negated=True),
    "regex_icase": _regex("text_data", "hash_text", "^C4CA", flags="i"),
    "regex_neg_icase": _regex("text_data", "hash_text", "^C4CA", negated=True, flags="i"),
    "regex_charclass": _regex("text_data", "hash_text", "[a-f]{5,}"),
    "regex_posix_class": _regex("text_data", "hash_text", "^[[:alpha:]]{3}[[:digit:]]+"),
    "regex_alternation": _regex("text_data", "hash_text", "^(c4|e4|a8)"),
    "in_expr_20": _in(20), "in_expr_128": _in(128), "in_expr_4096": _in(4096), "in_expr_4097": _in(4097), "in_expr_5000_null": _in(5000, null=True),
    "in_index_20": _count("bench_data", f"grp IN ({', '.join(map(str, range(1, 21)))})"),
    "in_list_small": _count("join_left", "key1 + 0 IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)"),
    "in_text_5": _count("text_data", "grp_text IN ('prefix_1', 'prefix_10', 'prefix_20', 'prefix_50', 'prefix_99')"),
    "in_text_20": _count("text_data", f"grp_text IN ({', '.join(repr(f'prefix_{5 * i}') for i in range(20))})"),
    "sort_topk": Query("SELECT key1 FROM join_left ORDER BY key1 + 0 LIMIT 10"),
    "sort_groupby": Query("SELECT key1 % 100 AS k, count(*) AS n FROM join_left GROUP BY key1 % 100 ORDER BY count(*) DESC, key1 % 100 LIMIT 10"),
    "numeric_agg": Query("SELECT grp_num, cast(sum(val1) as decimal(38,2)) AS s, round(avg(cast(val2 as double)), 6) AS a FROM numeric_data GROUP BY grp_num"),
    "numeric_arith": Query("SELECT cast(sum(val1 * val2 + val1 - val2) as decimal(38,4)) AS s FROM numeric_data"),
    "json_extract_num": Query("SELECT ISUM(cast(get_json_object(doc, '$.a') as int)) AS s FROM jsonb_data"),
    "json_extract_str": Query("SELECT count(get_json_object(doc, '$.b')) AS n FROM jsonb_data"),
    "json_filter": _count("jsonb_data", "cast(get_json_object(doc, '$.a') as int) = 42"),
    "json_agg": Query("SELECT grp_jsonb, count(*) AS n, ISUM(cast(get_json_object(doc, '$.a') as int)) AS s FROM jsonb_data GROUP BY grp_jsonb"),
    "json_contains": _count("jsonb_data", "get_json_object(doc, '$.a') = '42'"),
    "json_exists_key": _count("jsonb_data", "array_contains(json_object_keys(doc), 'a')", "list_contains(json_keys(doc), 'a')"),
    "array_overlap": Query("SELECT ISUM(CASE WHEN arrays_overlap(tags, array(1, 2, 3, 4, 5)) THEN 1 ELSE 0 END) AS s FROM array_data"),
    "array_contains_all": Query("SELECT ISUM(CASE WHEN array_contains(tags, 10) AND array_contains(tags, 20) THEN 1 ELSE 0 END) AS s FROM array_data"),
    "unnest_agg": Query("SELECT u, count(*) AS n FROM (SELECT explode(tags) AS u FROM array_data) t GROUP BY u"),
    "wide_10col_sum": Query(f"SELECT ISUM({'+'.join(f'c{k:02d}' for k in range(1, 11))}) AS s FROM ultra_wide"),
    "wide_20col_sum": Query(f"SELECT ISUM({'+'.join(f'c{k:02d}' for k in range(1, 21))}) AS s FROM ultra_wide"),
    "wide_groupby_expr": Query("SELECT grp, ISUM(c01*c02 + c03 - c04) AS s, DAVG(c10+c20) AS a FROM ultra_wide GROUP BY grp"),
    **{f"wide{n}_{k}": Query(q.format(n=n, last=n - 3, late=n - 9, span=_plus(*sorted({7, *(8 + n // 10 * j for j in range(1, 10))})), three=_plus(7, n // 2 - 2, n - 2))) for n in (100, 300, 1000) for k, q in {
        "sum": "SELECT ISUM(c{last:04d}) AS s FROM wide_{n}", "groupby": "SELECT grp, count(*) AS n, DAVG(c{last:04d}) AS a FROM wide_{n} GROUP BY grp", "filter": "SELECT count(*) AS n FROM wide_{n} WHERE c{late:04d} IS NOT NULL",
        "early2": "SELECT ISUM(coalesce(c0007, 0) + coalesce(c0008, 0)) AS s FROM wide_{n}", "span10": "SELECT ISUM({span}) AS s, count(*) AS n FROM wide_{n}", "last": "SELECT ISUM(grp) AS s FROM wide_{n}", "grpby3": "SELECT grp, count(*) AS n, ISUM({three}) AS s FROM wide_{n} GROUP BY grp"}.items()},
    **{f"rle_grp{n}_{k}": Query(q) for n in (100, 300, 1000) for k, q in {"last": f"SELECT ISUM(c{n:04d}) AS s FROM rle_grp_{n}", "span10": f"SELECT ISUM({_plus(7, *(8 + n // 10 * j for j in range(1, 10)))}) AS s FROM rle_grp_{n}", "grpby": f"SELECT grp, count(*) AS n, ISUM({_plus(7, n // 2 - 2, n - 2)}) AS s FROM rle_grp_{n} GROUP BY grp"}.items()},
    **{f"rle_rnd{n}_{k}": Query(q) for n in (100, 300, 1000) for k, q in {"last": f"SELECT ISUM(c{n // 6 * 6 - 1:04d}) AS s FROM rle_rnd_{n}", "span_int": f"SELECT ISUM({_plus(*(6 * (n // 60) * j + 5 for j in range(1, 9)))}) AS s FROM rle_rnd_{n}", "grpby": f"SELECT grp, count(*) AS n, ISUM({_plus(5, n // 12 * 6 - 1, n // 6 * 6 - 1)}) AS s FROM rle_rnd_{n} GROUP BY grp"}.items()},
    "partscan_filter": Query("SELECT count(*) AS n, ISUM(val) AS s FROM part_data WHERE grp BETWEEN 10 AND 30"),
    "partscan_agg_all": Query("SELECT grp, count(*) AS n, ISUM(val) AS s FROM part_data GROUP BY grp"),
    "case_20way": _case(20, "WHEN val < {hi} THEN {then}", 21, table="join_left"),
    "bool_20cond": _count("join_left", _bools),
    "agg_complex_10": Query("""SELECT grp, count(*) AS n, ISUM(cast(val1 as bigint) * val1) AS sq, DAVG(val2 + val3) AS a, min(val1 - val2 + val3) AS lo, max(val4 * 2 - val5) AS hi, ISUM(CASE WHEN val1 > 5000 THEN val2 ELSE val3 END) AS c,
        DAVG(abs(val1 - val2)) AS d, ISUM(val1 % 100 + val2 % 100) AS m, count(nullif(val3, 0)) AS k, ISUM(coalesce(nullif(val1, val2), 0)) AS z FROM bench_data GROUP BY grp"""),
    "long_like": _count("text_long", "long_text LIKE '%abcdef%'"),
    "long_ilike": _count("text_long", "long_text ILIKE '%ABCDEF%'"),
    "long_not_ilike": _count("text_long", "long_text NOT ILIKE '%ZZZZZZ%'"),
    "long_regex_alt": _regex("text_long", "long_text", "(abcd|efgh|1234)"),
    "long_regex_8alt": _regex("text_long", "long_text", "(abcd|efgh|1234|5678|abcf|def0|1abc|f012)"),
    "long_regex_icase": _regex("text_long", "long_text", "(ABCD|EFAB|1234)", flags="i"),
    "long_regex_class": _regex("text_long", "long_text", "[a-f]{8,}"),
    "long_combined": _count("text_long", "long_text ILIKE '%ABCDEF%' OR regexp_like(long_text, '(1234|5678|9abc)')"),
    **{f"case_lt_{n}": _case(n, "WHEN val1 < {hi} THEN {then}", n + 1) for n in (20, 50, 100)},
    **{f"case_eq_{n}": _case(n, "WHEN {lo} THEN {then}", 0, head="CASE val1") for n in (20, 50, 100)},
    "case_text_eq_50": _case(50, "WHEN 'row_{lo}' THEN {then}", 0, head="CASE txt"),
    "case_range_50": _case(50, "WHEN val1 >= {lo} AND val1 < {hi} THEN {then}", 0),
    "case_gt_50": _case(50, "WHEN val1 > 10000 - {hi} THEN {up}", 0),
    "case_between_50": _case(50, "WHEN val1 BETWEEN {lo} AND {hi} - 1 THEN {then}", 0),
    "case_ts_range_30": Query(f"SELECT count(*) AS n, min(adjusted) AS lo, max(adjusted) AS hi FROM (SELECT CASE {_thirty} ELSE ts END AS adjusted FROM date_data) sub"),
    "case_nested_3lvl": Query(f"SELECT ISUM(r) AS s FROM (SELECT {_nested} AS r FROM bench_data) t"),
    "is_json": _count("json_text", "try_parse_json(doc) IS NOT NULL", "json_valid(doc)"),
    "is_json_object": _count("json_text", "try_parse_json(doc) IS NOT NULL AND doc LIKE '{%'", "json_valid(doc) AND json_type(doc) = 'OBJECT'"),
    "cast_text_json": _count("json_text", "parse_json(doc) IS NOT NULL", "cast(doc as json) IS NOT NULL"),
    "cast_json_extract": Query("SELECT cast(sum(variant_get(parse_json(doc), '$.id', 'bigint')) as bigint) AS s FROM json_text", "SELECT cast(sum(cast(json_extract_string(doc, '$.id') as bigint)) as bigint) AS s FROM json_text"),
    "cast_json_contains": _count("json_text", "variant_get(parse_json(doc), '$.active', 'boolean')", "json_extract_string(doc, '$.active') = 'true'"),
    "cast_json_group": Query("SELECT tier, count(*) AS n, ISUM(cast(get_json_object(doc, '$.id') as bigint)) AS s FROM json_text GROUP BY tier"),
    "cast_json_large": Query("SELECT count(*) AS n, ISUM(cast(get_json_object(doc, '$.id') as bigint)) AS s FROM json_text WHERE tier = 2"),
    "current_date_filter": _count("date_data", "d < current_date"),
    "current_timestamp_expr": _count("date_data", "ts < current_timestamp"),
    "localtimestamp_diff": _count("date_data", "localtimestamp() - ts > INTERVAL '1' DAY", "localtimestamp - ts > INTERVAL '1' DAY"),
    "array_expr_int3": Query("SELECT array(val1, val2, val3) AS a FROM bench_data"),
    "array_expr_int5": Query("SELECT array(val1, val2, val3, val4, val5) AS a FROM bench_data"),
    "array_expr_text": Query("SELECT array(txt, cast(grp as string)) AS a FROM bench_data"),
    "field_select_int": Query("SELECT ISUM(rec.a) AS s FROM (SELECT named_struct('a', val1, 'b', val2, 'c', txt) AS rec FROM bench_data) t", "SELECT cast(sum(rec.a) as bigint) AS s FROM (SELECT {'a': val1, 'b': val2, 'c': txt} AS rec FROM bench_data) t"),
    "field_select_multi": Query("SELECT ISUM(rec.a + rec.b) AS s FROM (SELECT named_struct('a', val1, 'b', val2, 'c', txt) AS rec FROM bench_data) t", "SELECT cast(sum(rec.a + rec.b) as bigint) AS s FROM (SELECT {'a': val1, 'b': val2, 'c': txt} AS rec FROM bench_data) t"),
}
SUITE = {f"micro_{name}": q for name, q in SUITE.items()}
