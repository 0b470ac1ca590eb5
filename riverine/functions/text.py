"""Text scalars as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def number_sum(s: Column) -> Column:
    """Sum of all runs of digits."""
    return F.aggregate(F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1)), F.lit(0.0), lambda t, x: t + x.cast("double"))


def street_width(lanes: Column, default: float = 2, lane_width: float = 3.5) -> Column:
    """Width of the first lane count (default where it is no number), one lane at least."""
    return F.greatest(F.coalesce(F.split_part(lanes, F.lit(","), F.lit(1)).try_cast("double"), F.lit(float(default))), F.lit(1.0)) * lane_width


def duration_hours(label: Column) -> Column:
    """'24-hr', '60-min', '2-day' in hours; other units raise."""
    n, unit = F.split_part(label, F.lit("-"), F.lit(1)).cast("double"), F.split_part(label, F.lit("-"), F.lit(2))
    return F.when(unit.startswith("min"), n / 60).when(unit.startswith("hr") | unit.startswith("hour"), n).when(unit.startswith("day"), n * 24).otherwise(F.raise_error(F.concat(F.lit("unknown duration "), label)).cast("double"))


def node_key(s: Column) -> Column:
    """Integer ids as such, others null."""
    return s.try_cast("bigint")


def box_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(",", *[p.cast("string") for p in parts]), 256)


def _bound(value: Column, then) -> Column:
    """then(value), the value computed once and not wherever then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _times_exactly(x: Column, p: Column) -> tuple[Column, Column]:
    """(product, what its rounding left off), by splitting both factors in halves of 26 bits."""
    split = lambda v: (v * 134_217_729.0) - ((v * 134_217_729.0) - v)
    xh, ph = split(x), split(p)
    xl, pl = x - xh, p - ph
    return x * p, ((xh * ph - x * p) + xh * pl + xl * ph) + xl * pl


def general(x: Column, digits: int = 6) -> Column:
    """A number as C's %g writes it: `digits` significant digits, no trailing zeros, exponent form when very large or small.

    C rounds the binary value itself and not its shortest decimal form, so a
    number whose next digit is a lone 5 is decided by the exact product with a
    power of ten.
    """
    tens = F.array(*[F.lit(10.0**k) for k in range(max(digits + 4, 11))])
    trim = lambda s: F.when(F.instr(s, ".") > 0, F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    sign = lambda v: F.when(v < 0, F.lit("-")).otherwise("")

    def small(v, size):
        """Up to `digits` digits before the point: a whole number and its places."""

        def write(t):
            scale = F.get(tens, t["places"]).cast("long")
            point = F.when(t["places"] > 0, F.concat(F.lit("."), F.lpad((t["number"] % scale).cast("string"), t["places"], F.lit("0")))).otherwise("")
            return F.concat(sign(v), trim(F.concat(F.floor(t["number"] / scale).cast("string"), point)))

        def rounded(t):
            whole = F.floor(t["high"])
            over = t["high"] - whole
            up = (over > 0.5) | ((over == 0.5) & ((t["low"] > 0) | ((t["low"] == 0) & (whole % 2 == 1))))
            number = whole + up.cast("long")
            return F.when((size == digits - 1) & (number >= 10**digits), F.lit(f"{1:.0f}e+{digits:02d}")).otherwise(_bound(F.struct(number.alias("number"), t["places"].alias("places")), write))

        def scaled(places):
            high, low = _times_exactly(F.abs(v), F.get(tens, places))
            return _bound(F.struct(high.alias("high"), low.alias("low"), places.alias("places")), rounded)

        return _bound(F.lit(digits - 1) - size, scaled)

    def large(v, size):
        """More digits: remainders of doubles are exact too."""
        unit = F.get(tens, size - (digits - 1))

        def write(most):
            carry = (most >= 10**digits).cast("int")
            head = trim(F.concat(F.floor(most / F.when(carry == 1, F.lit(10**digits)).otherwise(10 ** (digits - 1))).cast("string"), F.lit("."), F.lpad((most % 10 ** (digits - 1)).cast("string"), digits - 1, "0")))
            return F.concat(sign(v), head, F.format_string("e+%02d", size + carry))

        rest = F.abs(v) % unit
        most = ((F.abs(v) - rest) / unit).cast("long")
        return _bound(most + ((rest > unit / 2) | ((rest == unit / 2) & (most % 2 == 1))).cast("long"), write)

    def power(v):
        sci = F.format_string(f"%.{digits - 1}e", v)
        return F.concat(trim(F.split_part(sci, F.lit("e"), F.lit(1))), F.lit("e"), F.split_part(sci, F.lit("e"), F.lit(2)))

    def write(v):
        size = F.when(v == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(v))).cast("int"))
        return _bound(size, lambda n: F.when(v.isNull() | n.isNull(), F.lit("")).when(n.between(-4, digits - 1), small(v, n)).when(n.between(digits, digits + 9), large(v, n)).otherwise(power(v)))

    return _bound(x, write)


def flag(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("")).when(x, F.lit("YES")).otherwise(F.lit("NO"))


def hours_minutes(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


METRIC_WEIR = math.sqrt(0.3048)
