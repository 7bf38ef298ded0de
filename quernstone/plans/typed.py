"""The rest of the scalar surface: typed results, remaining casts, unsigned and one-byte types, time, money and
interval comparison, hashes, rows, arrays, three-valued tests, constructors and bind parameters.

Types the engine lacks stand on one it has: one-byte characters and money on integers, unsigned 32- and 64-bit numbers
and log positions on wider ones, times on microseconds, ranges' distances on numbers.
"""

from __future__ import annotations

from quernstone.functions.scalar import interval_key, overflows, strict_float
from quernstone.plans.suite import Query
from quernstone.plans.surface import _compare

_u64 = "cast({} as decimal(20,0)) + 9223372036854775808"
_char = "ascii({})"
_time = "cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) as bigint) * 1000000"
_noon = "43200000000 - cast(a4 as bigint) * 1000000"
_cents = "cast(round(n1 * 100) as bigint)"
_span = "(VALUES (1, 1, 0, 0), (2, 0, 30, 0), (3, 0, 0, 86400000000), (4, 0, 1, 0), (5, -1, 31, 5), (6, 12, -3, 0)) AS {}(id, mo, dd, us)"
_key = interval_key("{0}.mo", "{0}.dd", "{0}.us")
_intervals = f"{_span.format('a')}, {_span.format('b')}"
_hashes = {"int2": "a2", "int4": "a4", "int8": "a8", "oid": "cast(b4 as bigint) + 4294960000", "bool": "p", "date": "d", "timestamp": "ts", "text": "s1", "numeric": "n1", "float4": "f4", "float8": "f8", "time": _time, "uuid": "md5(s1)"}


def _hash(extended: bool) -> Query:
    """Equal values have equal hashes; two relations' hashes agree. The values themselves are the engine's own."""
    call = "xxhash64({}) = xxhash64(coalesce({}, {}))" if extended else "hash({}) = hash(coalesce({}, {}))"
    sql = "SELECT id, " + ", ".join(f"{call.format(x, x, x)} AS {name}" for name, x in _hashes.items()) + " FROM operands"
    return Query(sql, "SELECT id, " + ", ".join(f"true AS {name}" for name in _hashes) + " FROM operands")


_rows = "(VALUES (1, 1, 2, 1, 3), (2, 2, 0, 1, 9), (3, 1, CAST(NULL AS int), 1, 2), (4, 1, CAST(NULL AS int), 2, 2), (5, 3, 3, 3, 3), (6, CAST(NULL AS int), 1, 1, 1), (7, CAST(NULL AS int), CAST(NULL AS int), 1, 1)) AS t(id, a, b, c, d)"
_row_lt = "CASE WHEN a < c THEN true WHEN a > c THEN false WHEN a = c THEN b < d END"
_row_gt = "CASE WHEN a > c THEN true WHEN a < c THEN false WHEN a = c THEN b > d END"
_three = "(VALUES (1, true), (2, false), (3, CAST(NULL AS boolean))) AS t(id, x)"
_arrays = "(VALUES (1, 10, 20, 30), (2, 7, 7, 7), (3, -1, 0, 1)) AS t(id, a, b, c)"
_floats = "(VALUES (1, 0.0e0), (2, -0.0e0), (3, cast('NaN' as double)), (4, 1.5e0), (5, CAST(NULL as double))) AS t(id, x)"
SUITE = {
    "typed_int_mul": Query("SELECT id, cast(cast(a2 % 100 as smallint) * cast(b2 as smallint) as smallint) AS m22, cast(a2 * b4 as int) AS m24, cast(a4 * b2 as int) AS m42, cast(a4 * b4 as int) AS m44 FROM operands"),
    "typed_int_overflow": Query(f"SELECT id, {overflows('cast(a4 as int)', '*', 2000000, 'int')} AS m4, {overflows('cast(a8 as bigint)', '+', 9223372036854775000, 'bigint')} AS p8, {overflows('cast(a4 as int)', '-', 2147480000, 'int')} AS s4 FROM operands",
        "SELECT id, abs(cast(a4 as bigint) * 2000000) > 2147483647 AS m4, cast(a8 as hugeint) + 9223372036854775000 > 9223372036854775807 AS p8, cast(a4 as bigint) - 2147480000 < -2147483648 AS s4 FROM operands"),
    "int_dec": Query("SELECT id, a8 - 1 AS dec8, b8 - 1 AS dec8_any, a8 + 1 AS inc8 FROM operands"),
    "float4_typed": Query("SELECT id, cast(f4 + g4 as float) AS pl, cast(f4 - g4 as float) AS mi, cast(f4 * g4 as float) AS mul, cast(f4 / g4 as float) AS div_, +f4 AS up4, +f8 AS up8 FROM operands"),
    "float_strict": Query(f"SELECT id, {strict_float('f8 * g8', 'f8', 'g8')} AS mul, {strict_float('f8 + g8', 'f8', 'g8')} AS pl FROM operands", "SELECT id, f8 * g8 AS mul, f8 + g8 AS pl FROM operands"),
    "casts_rest": Query("SELECT id, cast(f4 as double) AS ftod, cast(f8 as float) AS dtof, cast(a4 as float) AS i4tof, cast(a8 as float) AS i8tof, cast(a2 as float) AS i2tof, cast(rint(cast(g4 as double)) as bigint) AS ftoi8, cast(rint(g8) as smallint) AS dtoi2, cast(b4 as bigint) + 4294960000 AS oidtoi8, cast(b8 % 4294967296 as bigint) AS xid8toxid, ascii(s1) AS chartoi4, chr(65 + a2 % 20 + 20) AS i4tochar FROM operands",
        "SELECT id, cast(f4 as double) AS ftod, cast(f8 as float) AS dtof, cast(a4 as float) AS i4tof, cast(a8 as float) AS i8tof, cast(a2 as float) AS i2tof, cast(round_even(cast(g4 as double), 0) as bigint) AS ftoi8, cast(round_even(g8, 0) as smallint) AS dtoi2, cast(b4 as bigint) + 4294960000 AS oidtoi8, b8 % 4294967296 AS xid8toxid, ascii(s1) AS chartoi4, chr(cast(65 + a2 % 20 + 20 as int)) AS i4tochar FROM operands"),
    "cmp_char": Query(f"SELECT id, {_compare(_char.format('s1'), _char.format('s2'))} FROM operands"),
    "cmp_xid8": Query(f"SELECT id, {_compare(_u64.format('a8'), _u64.format('b8'))}, b4 = b2 AS xideq, b4 <> b2 AS xidneq, a4 = b4 AS cideq FROM operands"),
    "cmp_lsn": Query(f"SELECT id, {_compare(_u64.format('b8'), _u64.format('a8'))} FROM operands"),
    "cmp_bool": Query("SELECT id, CASE WHEN p = q THEN 0 WHEN p THEN 1 ELSE -1 END AS cmp FROM operands", "SELECT id, cast(p as int) - cast(q as int) AS cmp FROM operands"),
    "cmp_timestamp_date": Query(f"SELECT id, {_compare('ts', 'cast(date_add(d, cast(a2 % 2 as int)) as timestamp_ntz)')}, cast(d as timestamp_ntz) < ts AS date_lt FROM operands", f"SELECT id, {_compare('ts', 'cast(d + cast(a2 % 2 as int) as timestamp)')}, d < ts AS date_lt FROM operands"),
    "cmp_time": Query(f"SELECT id, {_compare(_time, _noon)} FROM operands", f"SELECT id, {_compare(_time, _noon)} FROM operands"),
    "cmp_money": Query(f"SELECT id, {_compare(_cents, 'cast(n2 * 100000 as bigint)')} FROM operands"),
    "cmp_uuid": Query(f"SELECT id, {_compare('md5(cast(a4 as string))', 'md5(cast(b4 as string))')} FROM operands"),
    "cmp_text_pattern": Query(f"SELECT p_partkey AS id, {_compare('cast(p_name as binary)', 'cast(p_type as binary)')} FROM part".replace("greatest(cast(p_name as binary), cast(p_type as binary)) AS larger, least(cast(p_name as binary), cast(p_type as binary)) AS smaller", "length(p_name) AS n"), f"SELECT p_partkey AS id, {_compare('encode(p_name)', 'encode(p_type)')} FROM part".replace("greatest(encode(p_name), encode(p_type)) AS larger, least(encode(p_name), encode(p_type)) AS smaller", "length(p_name) AS n")),
    "starts_with": Query("SELECT p_partkey, startswith(p_name, 's') AS s, startswith(p_name, '') AS e, startswith(p_name, lower(p_name)) AS w FROM part", "SELECT p_partkey, starts_with(p_name, 's') AS s, starts_with(p_name, '') AS e, starts_with(p_name, lower(p_name)) AS w FROM part"),
    "finite": Query("SELECT id, d BETWEEN date '0001-01-01' AND date '9999-12-31' AS date_finite, ts IS NOT NULL AS timestamp_finite FROM operands", "SELECT id, isfinite(d) AS date_finite, isfinite(ts) AS timestamp_finite FROM operands"),
    "timestamptz_arith": Query("SELECT id, cast(cast(cast(ts as timestamp) + INTERVAL '3' DAY as timestamp) as timestamp_ntz) AS pl, cast(cast(ts as timestamp) - INTERVAL '36' HOUR as timestamp_ntz) AS mi, cast(cast(ts as timestamp) + INTERVAL '2' MONTH as timestamp_ntz) AS mo FROM operands", "SELECT id, ts + INTERVAL '3' DAY AS pl, ts - INTERVAL '36' HOUR AS mi, ts + INTERVAL '2' MONTH AS mo FROM operands"),
    "interval_all": Query(f"SELECT a.id AS i, b.id AS j, {_compare(_key.format('a'), _key.format('b'))} FROM {_intervals}",
        f"SELECT a.id AS i, b.id AS j, {_compare('((a.mo * 30 + a.dd) * 86400000000::hugeint + a.us)', '((b.mo * 30 + b.dd) * 86400000000::hugeint + b.us)')} FROM {_intervals}"),
    "interval_pl_mi": Query("SELECT id, ts + (INTERVAL '1' DAY + make_dt_interval(0, cast(b2 as int))) AS pl, ts - (INTERVAL '2' DAY - INTERVAL '1' HOUR) AS mi FROM operands", "SELECT id, ts + (INTERVAL '1' DAY + to_hours(b2)) AS pl, ts - (INTERVAL '2' DAY - INTERVAL '1' HOUR) AS mi FROM operands"),
    "make_interval": Query("SELECT id, cast(cast(ts as timestamp) + make_interval(1, 2, 0, 3, 4, 5, 6) as timestamp_ntz) AS t FROM operands", "SELECT id, ts + (INTERVAL '14' MONTH + INTERVAL '3' DAY + INTERVAL '14706' SECOND) AS t FROM operands"),
    "extract_micros": Query("SELECT event_id, cast(extract(SECOND FROM ts) * 1000000 as bigint) AS us, cast(extract(SECOND FROM ts) * 1000 as bigint) AS ms FROM events", "SELECT event_id, extract(microsecond FROM ts) AS us, extract(microsecond FROM ts) // 1000 AS ms FROM events"),
    "range_subdiff": Query("SELECT id, cast(a4 - b4 as double) AS int4, cast(a8 - b8 as double) AS int8, cast(datediff(d, date '1996-02-29') as double) AS dates, cast(unix_micros(cast(ts as timestamp)) - 820454400000000 as double) / 1000000 AS ts_, cast(unix_micros(cast(ts as timestamp)) - 820454400000000 as double) / 1000000 AS tstz FROM operands",
        "SELECT id, cast(a4 - b4 as double) AS int4, cast(a8 - b8 as double) AS int8, cast(d - date '1996-02-29' as double) AS dates, cast(epoch_us(ts) - 820454400000000 as double) / 1000000 AS ts_, cast(epoch_us(ts) - 820454400000000 as double) / 1000000 AS tstz FROM operands"),
    "hash_equal": _hash(False),
    "hash_extended_equal": _hash(True),
    "float_in": Query(f"SELECT id, x IN (0.0e0, 9.0e0) AS zero, x IN (cast('NaN' as double)) AS nan_, x NOT IN (1.5e0, 2.5e0) AS others FROM {_floats}"),
    "row_compare": Query(f"SELECT id, {_row_lt} AS lt, {_row_gt} AS gt, NOT {_row_gt} AS le, struct(a, b) <=> struct(c, d) AS same FROM {_rows}", f"SELECT id, {_row_lt} AS lt, {_row_gt} AS gt, NOT {_row_gt} AS le, a IS NOT DISTINCT FROM c AND b IS NOT DISTINCT FROM d AS same FROM {_rows}"),
    "row_null_tests": Query(f"SELECT id, (a IS NULL AND b IS NULL) AS row_null, (a IS NOT NULL AND b IS NOT NULL) AS row_not_null, a IS NULL AS field_null FROM {_rows}"),
    "boolean_tests": Query(f"SELECT id, x IS TRUE AS t, x IS NOT TRUE AS nt, x IS FALSE AS f, x IS NOT FALSE AS nf, x IS NULL AS u, x IS NOT NULL AS nu FROM {_three}"),
    "try_cast": Query("SELECT s, try_cast(s AS int) AS i, try_cast(s AS date) AS d, try_cast(s AS double) AS f FROM (VALUES ('12'), ('x1'), ('2020-02-30'), ('2020-02-29'), (''), ('1e3')) AS t(s)", "SELECT s, CASE WHEN s = '12' THEN 12 END AS i, CASE WHEN s = '2020-02-29' THEN date '2020-02-29' END AS d, CASE WHEN s IN ('12', '1e3') THEN cast(s as double) END AS f FROM (VALUES ('12'), ('x1'), ('2020-02-30'), ('2020-02-29'), (''), ('1e3')) AS t(s)"),
    "domain_check": Query("SELECT id, CASE WHEN b2 IS NULL THEN raise_error('null in a domain') WHEN b2 < 1 THEN raise_error('check of a domain') ELSE b2 END AS v FROM operands", "SELECT id, b2 AS v FROM operands"),
    "array_coerce": Query(f"SELECT id, cast(array(a, b, c) as array<string>)[1] AS t, cast(array(a, b, c) as array<double>)[2] AS f FROM {_arrays}", f"SELECT id, cast(b as varchar) AS t, cast(c as double) AS f FROM {_arrays}"),
    "array_subscript": Query(f"SELECT id, array(a, b, c)[id - 1] AS at_, try_element_at(array(a, b, c), 9) AS beyond, array(10, 20, 30)[id % 3] AS pick, slice(array(a, b, c), 2, 2)[0] AS part FROM {_arrays}", f"SELECT id, CASE id WHEN 1 THEN a WHEN 2 THEN b ELSE c END AS at_, CAST(NULL AS int) AS beyond, CASE id % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 30 END AS pick, b AS part FROM {_arrays}"),
    "array_assign": Query(f"SELECT id, transform(array(a, b, c), (x, i) -> if(i = 1, 99, x))[1] AS set_, named_struct('a', a, 'b', 5).b AS field FROM {_arrays}", f"SELECT id, 99 AS set_, 5 AS field FROM {_arrays}"),
    "array_subquery": Query("SELECT r_regionkey, (SELECT array_join(sort_array(collect_list(n_name)), ',') FROM nation WHERE n_regionkey = r_regionkey) AS names FROM region", "SELECT r_regionkey, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS names FROM region"),
    "any_all": Query(f"SELECT id, exists(array(a, b, c), x -> x > 25) AS any_gt, forall(array(a, b, c), x -> x > -2) AS all_gt, exists(cast(array() as array<int>), x -> x > 1) AS any_empty, forall(cast(array() as array<int>), x -> x > 1) AS all_empty, exists(array(a, NULL), x -> x = 10) AS any_null FROM {_arrays}",
        f"SELECT id, a > 25 OR b > 25 OR c > 25 AS any_gt, a > -2 AND b > -2 AND c > -2 AS all_gt, false AS any_empty, true AS all_empty, CASE WHEN a = 10 THEN true END AS any_null FROM {_arrays}"),
    "whole_row": Query("SELECT to_json(struct(n_nationkey, n_name)) AS doc FROM nation", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS doc FROM nation"),
    "json_constructors": Query("SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'tags', array(n_name, 'x'))) AS obj, to_json(array(n_nationkey, n_regionkey)) AS arr, get_json_object(to_json(named_struct('a', named_struct('b', n_regionkey))), '$.a.b') AS value_ FROM nation", "SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"tags\":[\"' || n_name || '\",\"x\"]}' AS obj, '[' || n_nationkey || ',' || n_regionkey || ']' AS arr, cast(n_regionkey as varchar) AS value_ FROM nation"),
    "json_on_error": Query("SELECT s, try_cast(get_json_object(s, '$.a') AS int) AS v, coalesce(try_cast(get_json_object(s, '$.a') AS int), -1) AS d FROM (VALUES ('{\"a\": 5}'), ('{\"a\": \"x\"}'), ('{}'), ('nope')) AS t(s)", "SELECT s, CASE WHEN s = '{\"a\": 5}' THEN 5 END AS v, CASE WHEN s = '{\"a\": 5}' THEN 5 ELSE -1 END AS d FROM (VALUES ('{\"a\": 5}'), ('{\"a\": \"x\"}'), ('{}'), ('nope')) AS t(s)"),
    "xml": Query("SELECT n_nationkey, xpath_string(concat('<n><name>', n_name, '</name></n>'), 'n/name') AS name, xpath_int('<a><b>3</b><b>4</b></a>', 'sum(a/b)') AS total FROM nation", "SELECT n_nationkey, n_name AS name, 7 AS total FROM nation"),
    "count_distinct_pairs": Query("SELECT s1, count(DISTINCT s2, a2) AS pairs, round(sum(cast(f4 as double)), 0) AS total4 FROM operands GROUP BY s1", "SELECT s1, count(DISTINCT (s2, a2)) AS pairs, round(sum(cast(f4 as double)), 0) AS total4 FROM operands GROUP BY s1"),
    "bind_parameters": Query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = :who AND o_totalprice > :least", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 17 AND o_totalprice > 1000.5", args={"who": 17, "least": 1000.5}),
}
SUITE = {f"fn_{name}": q for name, q in SUITE.items()}
