"""Spellings of scalar functions whose plain form in the engine means something else.

Each helper returns SQL text, so it stays within whole-stage code generation.
"""

from __future__ import annotations

LIMITS = {kind: (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1) for kind, bits in (("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64))}


def int_div(a: str, b: str, kind: str) -> str:
    """Integer division that truncates toward zero, in the operands' type."""
    return f"cast({a} div {b} as {kind})"


def half_even(x: str, kind: str) -> str:
    """A float as an integer, halves to the even neighbour; NaN and what is out of range raise."""
    return f"cast(rint({x}) as {kind})"


def three_way(a: str, b: str) -> str:
    """-1, 0 or 1 as a is smaller, equal or larger; NaN is equal to itself and larger than all else."""
    return f"CASE WHEN {a} < {b} THEN -1 WHEN {a} = {b} THEN 0 WHEN {a} > {b} THEN 1 END"


def epoch(ts: str) -> str:
    """Seconds since 1970 of a timestamp without zone, with fractions."""
    return f"(unix_micros(cast({ts} as timestamp)) / 1000000)"


def interval_key(months: str, days: str, micros: str) -> str:
    """What intervals are ordered by: a month counts as 30 days, a day as 24 hours."""
    return f"(cast({months} as decimal(38,0)) * 30 + {days}) * 86400000000 + {micros}"


def strict_float(x: str, *operands: str) -> str:
    """x, or an error if it overflowed: infinite although no operand is."""
    finite = " AND ".join(f"abs({o}) < double('Infinity')" for o in operands)
    return f"CASE WHEN abs({x}) = double('Infinity') AND {finite} THEN raise_error('value out of range: overflow') ELSE {x} END"


def masked_shift(x: str, count: str, bits: int, left: bool = True) -> str:
    """A shift whose count is taken modulo the width, in the operand's type."""
    return f"{'shiftleft' if left else 'shiftright'}({x}, cast({count} & {bits - 1} as int))"


def overflows(x: str, sign: str, number: int, kind: str) -> str:
    """Whether x + number, x - number or x * number leaves the integer kind; null for a null x.

    x is compared with the least and greatest value that do not overflow: the engine's try_ functions raise and catch an
    exception for each row that does.
    """
    least, most = LIMITS[kind]
    if sign == "*":
        ends = (least, most) if number > 0 else (most, least)
        low, high = (-(-ends[0] // number), ends[1] // number) if number else (least, most)
    else:
        low, high = (end - number if sign == "+" else end + number for end in (least, most))
    return f"({x} NOT BETWEEN {max(low, least)} AND {min(high, most)})"
