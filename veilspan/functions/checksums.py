"""Checksums of identifiers as column expressions; each is false, never null, for a value of the wrong shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digit(x: Column, i: int) -> Column:
    return F.substring(x, i, 1).cast("int")


def tckn_valid(value: Column) -> Column:
    """Eleven digits, the first not zero; the tenth and eleventh are check digits."""
    x = F.trim(value)
    d = [_digit(x, i) for i in range(1, 12)]
    odd, even = d[0] + d[2] + d[4] + d[6] + d[8], d[1] + d[3] + d[5] + d[7]
    ok = (F.pmod(odd * 7 - even, F.lit(10)) == d[9]) & (F.pmod(odd + even + d[9], F.lit(10)) == d[10])
    return F.coalesce(F.when(x.rlike("^[1-9][0-9]{10}$"), ok), F.lit(False))


def vkn_valid(value: Column) -> Column:
    """Ten digits; each of the first nine is shifted by its place, weighted by a power of two modulo 9."""
    x = F.trim(value)
    total = F.lit(0)
    for i in range(1, 10):
        c = F.pmod(_digit(x, i) + (10 - i), F.lit(10))
        total = total + F.when(c == 9, 9).otherwise(F.pmod(c * (1 << (10 - i)), F.lit(9)))
    ok = F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)) == _digit(x, 10)
    return F.coalesce(F.when(x.rlike("^[0-9]{10}$"), ok), F.lit(False))


def iban_valid(value: Column) -> Column:
    """TR and 24 digits, white space aside; rotated by four, letters as numbers, the remainder by 97 is one."""
    x = F.upper(F.regexp_replace(value, r"\s+", ""))
    number = F.concat(F.substring(x, 5, 22), F.lit("2927"), F.substring(x, 3, 2))  # T is 29, R is 27
    rest = F.lit(0).cast("long")
    for at in range(1, 29, 7):  # seven digits at a time stay far below a long's range
        rest = F.pmod(rest * 10_000_000 + F.substring(number, at, 7).cast("long"), F.lit(97))
    return F.coalesce(F.when(x.rlike("^TR[0-9]{24}$"), rest == 1), F.lit(False))


def luhn_valid(value: Column) -> Column:
    x = F.regexp_replace(value, "[^0-9]", "")
    return F.coalesce(F.length(x).between(13, 19) & F.call_function("luhn_check", x), F.lit(False))


VALIDATORS = {"tckn": tckn_valid, "vkn": vkn_valid, "iban": iban_valid, "luhn": luhn_valid}
