"""The scalar function surface by type family: arithmetic, comparison, casts, dates, intervals, text, numerics.

Each query evaluates all functions of a family on columns of that family's types. The engine runs with ANSI errors,
so an overflow or a zero divisor raises as it should; where the engine's own function means something else, the
helper's spelling is used (integer division, shifts, half-even casts, day-of-week fields).
"""

from __future__ import annotations

from quernstone.functions.scalar import epoch, half_even, int_div, three_way
from quernstone.plans.suite import FIXTURES, Query

FIXTURES["operands"] = """SELECT cast(l_orderkey * 8 + l_linenumber as bigint) AS id, cast((l_partkey % 150) - 75 as smallint) AS a2, cast((l_suppkey % 90) + 1 as smallint) AS b2, cast((l_partkey * 31 % 20000) - 10000 as int) AS a4,
    cast(l_suppkey * 7 % 300 + 1 as int) AS b4, cast(l_orderkey * 1000003 - 500000000 as bigint) AS a8, cast(l_partkey * 17 + 1 as bigint) AS b8, cast(l_extendedprice as float) AS f4, cast(l_quantity + 0.5 as float) AS g4,
    l_extendedprice AS f8, l_quantity - 25.5 AS g8, cast(l_extendedprice as decimal(15,2)) AS n1, cast(l_quantity as decimal(10,3)) AS n2, l_shipdate AS ts, cast(l_shipdate as date) AS d, l_returnflag AS s1, l_linestatus AS s2,
    l_returnflag = 'A' AS p, l_linestatus = 'O' AS q FROM lineitem"""

_signs = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
_widest = {"2": "smallint", "4": "int", "8": "bigint"}


def _compare(a: str, b: str) -> str:
    return ", ".join([*(f"{a} {sign} {b} AS {name}" for name, sign in _signs.items()), f"{three_way(a, b)} AS cmp", f"greatest({a}, {b}) AS larger", f"least({a}, {b}) AS smaller"])


def _ints(x: str, y: str) -> str:
    """All operators of two integer widths; the result has the wider one."""
    a, b, kind = f"a{x}", f"b{y}", _widest[max(x, y)]
    cast = f"cast({a} as {kind})", f"cast({b} as {kind})"
    return ", ".join([f"cast({cast[0]} + {cast[1]} as {kind}) AS pl", f"cast({cast[0]} - {cast[1]} as {kind}) AS mi", f"cast({cast[0]} as bigint) * {b} AS mul" if kind != "bigint" else f"{a} * cast({b} % 100 as bigint) AS mul", f"{int_div(*cast, kind)} AS div_", f"cast({cast[0]} % {cast[1]} as {kind}) AS mod_"])


_q = {}
for _x in "248":
    for _y in "248":
        _q[f"int{_x}{_y}"] = Query(f"SELECT id, {_ints(_x, _y)} FROM operands")
        _q[f"cmp_int{_x}{_y}"] = Query(f"SELECT id, {_compare(f'a{_x}', f'b{_y}')} FROM operands")
    _kind = _widest[_x]
    _q[f"unary_int{_x}"] = Query(f"SELECT id, cast(abs(a{_x}) as {_kind}) AS abs_, cast(-a{_x} as {_kind}) AS um, +a{_x} AS up, cast(a{_x} + 1 as {_kind}) AS inc FROM operands")
    _q[f"bits_int{_x}"] = Query(f"SELECT id, cast(a{_x} & b{_x} as {_kind}) AS and_, cast(a{_x} | b{_x} as {_kind}) AS or_, cast(a{_x} ^ b{_x} as {_kind}) AS xor_, cast(~a{_x} as {_kind}) AS not_ FROM operands", f"SELECT id, a{_x} & b{_x} AS and_, a{_x} | b{_x} AS or_, xor(a{_x}, b{_x}) AS xor_, ~a{_x} AS not_ FROM operands")
    _q[f"shift_int{_x}"] = Query(f"SELECT id, cast(shiftleft(cast(b{_x} as {'bigint' if _x == '8' else 'int'}), 3) as bigint) AS shl, cast(shiftright(cast(a{_x} as {'bigint' if _x == '8' else 'int'}), 2) as bigint) AS shr FROM operands", f"SELECT id, cast(b{_x} as bigint) << 3 AS shl, cast(a{_x} as bigint) >> 2 AS shr FROM operands")
for _a, _b, _n in (("f4", "g4", "44"), ("f8", "g8", "88"), ("f4", "g8", "48"), ("f8", "g4", "84")):
    _q[f"float{_n}"] = Query(f"SELECT id, cast({_a} as double) + {_b} AS pl, cast({_a} as double) - {_b} AS mi, cast({_a} as double) * {_b} AS mul, cast({_a} as double) / {_b} AS div_, abs({_b}) AS abs_, -{_b} AS um FROM operands")
    _q[f"cmp_float{_n}"] = Query(f"SELECT id, {_compare(_a, _b)} FROM operands")
_nan = "(VALUES (1, cast('NaN' as double), 1.0e0), (2, cast('NaN' as double), cast('NaN' as double)), (3, 0.0e0, -0.0e0), (4, cast('Infinity' as double), cast('NaN' as double)), (5, cast('-Infinity' as double), 1.0e0), (6, CAST(NULL as double), 1.0e0)) AS t(id, x, y)"
SUITE = {
    **_q,
    "float_special": Query(f"SELECT id, {', '.join(f'x {s} y AS {n}' for n, s in _signs.items())} FROM {_nan}"),
    "cast_int_widening": Query("SELECT id, cast(a2 as int) AS i24, cast(a2 as bigint) AS i28, cast(a4 as bigint) AS i48, cast(a4 as double) AS i4d, cast(a8 as double) AS i8d, cast(a2 as double) AS i2d, cast(a4 % 100 as smallint) AS i42, cast(b8 % 100000 as int) AS i84, cast(b8 % 1000 as smallint) AS i82 FROM operands"),
    "cast_float_int": Query(f"SELECT id, {half_even('g8', 'int')} AS f8i4, {half_even('g8', 'bigint')} AS f8i8, {half_even('g4', 'smallint')} AS f4i2, {half_even('cast(g4 as double)', 'int')} AS f4i4 FROM operands", "SELECT id, cast(g8 as int) AS f8i4, cast(g8 as bigint) AS f8i8, cast(g4 as smallint) AS f4i2, cast(g4 as int) AS f4i4 FROM operands"),
    "cast_bool": Query("SELECT id, cast(p as int) AS b4, cast(a4 as boolean) AS i4b, cast(cast(p as int) as boolean) AS round_trip FROM operands"),
    "cast_text": Query("SELECT id, cast(a4 as string) AS t4, cast(cast(a8 as string) as bigint) AS back, cast(d as string) AS td, cast('2020-02-29' as date) AS dd, cast(n1 as string) AS tn FROM operands"),
    "bool_ops": Query(f"SELECT id, p AND q AS and_, p OR q AS or_, NOT p AS not_, {_compare('p', 'q').split(', CASE')[0]}, p IS NOT DISTINCT FROM q AS same, (nullif(a2, 0) IS NULL) AS n FROM operands"),
    "bool_three_valued": Query("SELECT a, b, a AND b AS and_, a OR b AS or_, NOT a AS not_, a IS TRUE AS t, a IS NOT FALSE AS nf, a IS NULL AS n FROM (VALUES (true, true), (true, false), (true, NULL), (false, false), (false, NULL), (CAST(NULL AS boolean), CAST(NULL AS boolean))) AS t(a, b)"),
    "numeric_ops": Query("SELECT id, cast(n1 + n2 as decimal(20,3)) AS pl, cast(n1 - n2 as decimal(20,3)) AS mi, cast(n1 * n2 as decimal(30,5)) AS mul, abs(n2 - 25) AS abs_, -n1 AS um, cast(n1 % 7 as decimal(10,2)) AS mod_ FROM operands"),
    "cmp_numeric": Query(f"SELECT id, {_compare('n1', 'n2')} FROM operands"),
    "numeric_round": Query("SELECT id, round(n1, 1) AS r1, cast(floor(n1) as bigint) AS f, cast(ceil(n1) as bigint) AS c, sign(cast(n2 - 25 as double)) AS s FROM operands"),
    "money_cents": Query("SELECT id, cast(n1 * 100 as bigint) + 5 AS pl, cast(n1 * 100 as bigint) - 5 AS mi, cast(n1 * 100 as bigint) * 3 AS mul FROM operands"),
    "unsigned_64": Query("SELECT id, cast(a8 as decimal(20,0)) + 9223372036854775808 > cast(b8 as decimal(20,0)) + 9223372036854775807 AS gt, cast(a8 as decimal(20,0)) + 9223372036854775808 = cast(b8 as decimal(20,0)) + 9223372036854775808 AS eq FROM operands"),
    "oid_unsigned_32": Query(f"SELECT id, {_compare('cast(b4 as bigint) + 4294960000', 'cast(b2 as bigint) + 4294960000')} FROM operands"),
    "cmp_timestamp": Query(f"SELECT id, {_compare('ts', 'cast(d as timestamp_ntz)')} FROM operands"),
    "cmp_date": Query(f"SELECT id, {_compare('d', chr(39).join(['date ', '1998-06-01', '']))} FROM operands"),
    "cmp_date_timestamp": Query("SELECT id, d = ts AS eq, d <> ts AS ne, d < ts AS lt, d <= ts AS le, d > ts AS gt, d >= ts AS ge, ts > d AS rgt, ts <= d AS rle FROM operands"),
    "cmp_text": Query(f"SELECT id, {_compare('s1', 's2')}, concat(s1, s2) AS cat, s1 || '-' || s2 AS bars FROM operands"),
    "date_arith": Query("SELECT id, date_add(d, 40) AS pl, date_sub(d, 40) AS mi, datediff(d, date '1996-02-29') AS diff, cast(d as timestamp_ntz) AS t FROM operands", "SELECT id, cast(d + 40 as date) AS pl, cast(d - 40 as date) AS mi, cast(d - date '1996-02-29' as int) AS diff, cast(d as timestamp) AS t FROM operands"),
    "timestamp_arith": Query("SELECT id, ts + INTERVAL '3' DAY AS pl, ts - INTERVAL '5' HOUR AS mi, ts + INTERVAL '1' MONTH AS mo, ts - INTERVAL '1' YEAR AS yr FROM operands"),
    "timestamp_minus": Query(f"SELECT id, {epoch('ts')} - {epoch(chr(39).join(['timestamp_ntz ', '1996-01-01 00:00:00', '']))} AS seconds FROM operands", "SELECT id, epoch(ts) - epoch(timestamp '1996-01-01 00:00:00') AS seconds FROM operands"),
    "extract_fields": Query(f"SELECT id, cast(year(ts) as bigint) AS y, cast(quarter(ts) as bigint) AS q, cast(month(ts) as bigint) AS m, cast(weekofyear(ts) as bigint) AS w, cast(day(ts) as bigint) AS dd, cast(dayofyear(ts) as bigint) AS doy, cast(dayofweek(ts) - 1 as bigint) AS dow, cast(weekday(ts) + 1 as bigint) AS isodow, cast(hour(ts) as bigint) AS h, cast(minute(ts) as bigint) AS mi, {epoch('ts')} AS ep FROM operands",
        "SELECT id, extract(year FROM ts) AS y, extract(quarter FROM ts) AS q, extract(month FROM ts) AS m, extract(week FROM ts) AS w, extract(day FROM ts) AS dd, extract(doy FROM ts) AS doy, extract(dow FROM ts) AS dow, extract(isodow FROM ts) AS isodow, extract(hour FROM ts) AS h, extract(minute FROM ts) AS mi, epoch(ts) AS ep FROM operands"),
    "trunc_fields": Query("SELECT id, cast(date_trunc('year', ts) as date) AS y, cast(date_trunc('quarter', ts) as date) AS q, cast(date_trunc('month', ts) as date) AS m, cast(date_trunc('week', ts) as date) AS w, cast(date_trunc('day', ts) as date) AS dd FROM operands"),
    "month_end": Query("SELECT d, cast(d + INTERVAL '1' MONTH as date) AS m1, cast(d - INTERVAL '1' MONTH as date) AS b1, cast(d + INTERVAL '1' YEAR as date) AS y1 FROM (VALUES (date '2020-01-31'), (date '2019-01-31'), (date '2020-02-29'), (date '2020-12-31')) AS t(d)"),
    "to_char": Query("SELECT id, rpad(date_format(ts, 'MMMM'), 9, ' ') AS mon, rpad(date_format(ts, 'EEEE'), 9, ' ') AS dy FROM operands", "SELECT id, rpad(strftime(ts, '%B'), 9, ' ') AS mon, rpad(strftime(ts, '%A'), 9, ' ') AS dy FROM operands"),
    "interval_order": Query("SELECT a.id AS i, b.id AS j, (a.mo * 30 + a.dd) * 86400 + a.sec < (b.mo * 30 + b.dd) * 86400 + b.sec AS lt, (a.mo * 30 + a.dd) * 86400 + a.sec = (b.mo * 30 + b.dd) * 86400 + b.sec AS eq FROM (VALUES (1, 1, 0, 0), (2, 0, 30, 0), (3, 0, 0, 86400), (4, 0, 1, 0)) AS a(id, mo, dd, sec), (VALUES (1, 1, 0, 0), (2, 0, 30, 0), (3, 0, 0, 86400), (4, 0, 1, 0)) AS b(id, mo, dd, sec)",
        "SELECT a.id AS i, b.id AS j, a.v < b.v AS lt, a.v = b.v AS eq FROM (VALUES (1, interval '1 month'), (2, interval '30 days'), (3, interval '24 hours'), (4, interval '1 day')) AS a(id, v), (VALUES (1, interval '1 month'), (2, interval '30 days'), (3, interval '24 hours'), (4, interval '1 day')) AS b(id, v)"),
    "time_micros": Query(f"SELECT id, {epoch('ts')} % 86400 AS sec, hour(ts) * 3600 + minute(ts) * 60 < 43200 AS morning FROM operands", "SELECT id, epoch(ts) % 86400 AS sec, hour(ts) * 3600 + minute(ts) * 60 < 43200 AS morning FROM operands"),
    "text_functions": Query("SELECT p_partkey, char_length(p_name) AS n, upper(p_name) AS u, lower(p_brand) AS l, substring(p_name, 2, 4) AS sub, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, repeat(p_type, 2) AS rep, md5(p_name) AS h, replace(p_name, 'e', 'E') AS r, trim(concat('  ', p_type, ' ')) AS t, split_part(p_name, ' ', 2) AS second, reverse(p_brand) AS rev, concat_ws('|', p_brand, p_type) AS ws, left(p_name, 3) AS le, right(p_name, 3) AS ri, ascii(p_name) AS asc_, chr(65 + p_size % 26) AS ch FROM part"),
    "text_multibyte": Query("SELECT s, char_length(s) AS n, octet_length(s) AS b, substring(s, 2, 3) AS sub, upper(s) AS u FROM (VALUES ('héllo wörld'), ('日本語テキスト'), ('Ωmega'), ('')) AS t(s)", "SELECT s, length(s) AS n, octet_length(encode(s)) AS b, substring(s, 2, 3) AS sub, upper(s) AS u FROM (VALUES ('héllo wörld'), ('日本語テキスト'), ('Ωmega'), ('')) AS t(s)"),
    "text_null": Query("SELECT 'a' || CAST(NULL AS string) AS bars, coalesce(CAST(NULL AS string), 'x') AS c, greatest(1, NULL, 3) AS g, least(NULL, 2) AS l, nullif(3, 3) AS n"),
    "in_three_valued": Query("SELECT x, x IN (1, NULL) AS i, x NOT IN (1, NULL) AS ni, x IN (1, 2) AS k FROM (VALUES (1), (2), (CAST(NULL AS int))) AS t(x)"),
    "like_contract": Query("SELECT s, s LIKE 'a%' AS p, s LIKE '_b%' AS u, s LIKE '%c' AS f, s LIKE 'a\\\\%b' AS e, s ILIKE 'AB%' AS i, s LIKE '' AS z FROM (VALUES ('abc'), ('a%b'), ('aXb'), (''), ('Abc'), ('éb')) AS t(s)", "SELECT s, s LIKE 'a%' AS p, s LIKE '_b%' AS u, s LIKE '%c' AS f, s LIKE 'a\\%b' ESCAPE '\\' AS e, s ILIKE 'AB%' AS i, s LIKE '' AS z FROM (VALUES ('abc'), ('a%b'), ('aXb'), (''), ('Abc'), ('éb')) AS t(s)"),
    "uuid_text": Query("SELECT u, lower(u) < 'a0000000-0000-0000-0000-000000000000' AS lt, lower(u) = lower('6F9619FF-8B86-D011-B42D-00C04FC964FF') AS eq FROM (VALUES ('6f9619ff-8b86-d011-b42d-00c04fc964ff'), ('F0000000-0000-0000-0000-000000000001')) AS t(u)"),
    "case_null_operand": Query("SELECT x, CASE x WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'other' END AS eq, CASE WHEN x < 10 THEN 'low' WHEN x < 20 THEN 'mid' WHEN x <= 30 THEN 'high' ELSE 'else' END AS lt FROM (VALUES (1), (2), (10), (20), (30), (31), (CAST(NULL AS int))) AS t(x)"),
    "case_by_type": Query("SELECT id, CASE WHEN a2 < 0 THEN 'a' WHEN a2 < 20 THEN 'b' WHEN a2 < 50 THEN 'c' ELSE 'd' END AS k2, CASE WHEN a8 < 0 THEN 'a' WHEN a8 < 1000000 THEN 'b' ELSE 'c' END AS k8, CASE WHEN g8 <= -10 THEN 'a' WHEN g8 <= 0 THEN 'b' WHEN g8 <= 10 THEN 'c' ELSE 'd' END AS kf, CASE WHEN d < date '1996-01-01' THEN 'a' WHEN d < date '1998-01-01' THEN 'b' ELSE 'c' END AS kd, CASE WHEN n1 > 50000 THEN 'a' WHEN n1 > 20000 THEN 'b' ELSE 'c' END AS kn, CASE s1 WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS ks, CASE WHEN ts >= cast('1999-01-01' as timestamp_ntz) THEN 'a' ELSE 'b' END AS kt FROM operands"),
    "math_functions": Query("SELECT id, round(sqrt(f8), 5) AS sq, round(ln(f8), 6) AS ln_, round(exp(g8 / 20), 5) AS ex, round(power(g8, 2), 3) AS pw, floor(g8) AS fl, ceil(g8) AS ce, sign(g8) AS sg FROM operands"),
}
SUITE = {f"fn_{name}": q for name, q in SUITE.items()}
