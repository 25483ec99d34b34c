"""Scalar functions with exact input, output and order rules, as built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of which any prefix is a boolean, and those that must be whole.
TRUE_WORDS, FALSE_WORDS, WHOLE_TRUE, WHOLE_FALSE = ("true", "yes"), ("false", "no"), ("on", "1"), ("off", "0")


def bool_in(text: Column) -> Column:
    """Trimmed text as boolean: a lower-case prefix of true, yes, false, no; or on, off, 1, 0; else null."""
    t = F.trim(text)
    some = F.length(t) > 0
    prefix = lambda words: reduce(lambda a, b: a | b, (F.lit(w).startswith(t) for w in words))
    return F.when(some & (prefix(TRUE_WORDS) | t.isin(*WHOLE_TRUE)), True).when(some & (prefix(FALSE_WORDS) | t.isin(*WHOLE_FALSE)), False)


def bool_out(value: Column) -> Column:
    return F.when(value, "t").when(~value, "f")


def int_in(text: Column) -> Column:
    """The number that a text begins with, after white space; 0 if it begins with none."""
    digits = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(text.isNotNull(), F.coalesce(digits.try_cast("long"), F.lit(0).cast("long")))


def float_in(text: Column) -> Column:
    """The number that a text begins with, after white space, as a double; inf and nan by name; 0 if it begins with none."""
    number = F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    named = F.lower(F.regexp_extract(text, r"^\s*([+-]?(?i:inf|nan))", 1))
    special = F.when(F.endswith(named, F.lit("nan")), float("nan")).when(F.endswith(named, F.lit("inf")), F.when(F.startswith(named, F.lit("-")), float("-inf")).otherwise(float("inf")))
    return F.when(text.isNotNull(), F.coalesce(special, number.try_cast("double"), F.lit(0.0)))


def oid_in(text: Column) -> Column:
    """int_in, kept to 32 bits without a sign."""
    return F.pmod(int_in(text), F.lit(1 << 32))


def char_in(text: Column) -> Column:
    """The first character."""
    return F.substring(text, 1, 1)


def varchar_out(text: Column) -> Column:
    """A text as it is, spaces at its end too."""
    return text.cast("string")


def general(value: Column, digits: int) -> Column:
    """A finite number with so many significant digits at most, as C's %.*g: plain from 1e-4 to below 10 ** digits, else with an exponent; no zeros at the end.

    Digits are rounded from the shortest decimal that stands for the number.
    """
    shown = F.format_string(f"%.{digits - 1}e", value)
    sign = F.when(F.startswith(shown, F.lit("-")), "-").otherwise("")
    bare = F.regexp_replace(F.regexp_extract(shown, r"^-?([0-9.]+)e", 1), r"\.", "")
    exponent = F.regexp_extract(shown, r"e([+-][0-9]+)$", 1).cast("int")
    some = F.regexp_replace(bare, "0+$", "")
    point = lambda whole, rest: F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("."), rest))
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), some)
    above = point(F.rpad(F.substring(some, F.lit(1), exponent + 1), exponent + 1, F.lit("0")), F.substring(some, exponent + 2, F.lit(digits)))
    power = F.concat(point(F.substring(some, 1, 1), F.substring(some, 2, digits)), F.lit("e"), F.regexp_extract(shown, r"e([+-][0-9]+)$", 1))
    return F.when(some == "", F.concat(sign, F.lit("0"))).when((exponent < -4) | (exponent >= digits), F.concat(sign, power)).when(exponent < 0, F.concat(sign, below)).otherwise(F.concat(sign, above))


#: Significant digits of doubles and floats as text.
DOUBLE_DIGITS, FLOAT_DIGITS = 16, 7


def float_out(value: Column, digits: int = DOUBLE_DIGITS) -> Column:
    return F.when(F.isnan(value), "NaN").when(value == float("inf"), "Infinity").when(value == float("-inf"), "-Infinity").otherwise(general(value, digits))


def three_way(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either is null; NaN is equal to itself and above all numbers."""
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)


def interval_span(months: Column, days: Column, micros: Column) -> Column:
    """The length by which intervals compare, in microseconds: a month has 30 days, a day 24 hours."""
    return micros + (months * 30 + days) * F.lit(86_400_000_000)


def vector_order(values: Column) -> Column:
    """Sort key of an integer vector: its length first, then its elements."""
    return F.struct(F.size(values).alias("n"), values.alias("v"))


def inet_order(text: Column) -> Column:
    """Sort key of an IPv4 network a.b.c.d/n: common bits first, then the shorter mask, then the address."""
    part = F.split(F.split_part(text, F.lit("/"), F.lit(1)), r"\.")
    number = reduce(lambda a, i: a * 256 + F.element_at(part, i).cast("long"), (2, 3, 4), F.element_at(part, 1).cast("long"))
    bits = F.when(F.contains(text, F.lit("/")), F.split_part(text, F.lit("/"), F.lit(2)).cast("int")).otherwise(32)
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("long")
    network = (number - F.pmod(number, size)).cast("long")
    return F.struct(network.alias("network"), bits.alias("bits"), number.alias("address"))


def timetz_order(time_micros: Column, zone_seconds_west: Column) -> Column:
    """Sort key of a time with zone: its time in UTC, then the zone."""
    return F.struct((time_micros + zone_seconds_west * F.lit(1_000_000)).alias("utc"), zone_seconds_west.alias("zone"))


def name_in(text: Column, bytes_held: int = 63) -> Column:
    """A name cut to the bytes that it may have (for ASCII names)."""
    return F.substring(text, 1, bytes_held)


def date_to_timestamp(date: Column) -> Column:
    return date.cast("timestamp_ntz")


def quote(text: Column) -> Column:
    """A text literal: in single quotes, those within doubled."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
