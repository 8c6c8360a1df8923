"""Canonical forms: what makes two spellings of one identifier the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def email(x: Column) -> Column:
    t = F.trim(x)
    at = F.locate("@", t)
    return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at), F.lower(F.substring(t, at + 1, F.length(t))))).otherwise(t)


def iban(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, r"[\s\u00a0-]+", ""))


def name(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))


def phone(x: Column) -> Column:
    d = F.regexp_replace(x, "[^0-9+]", "")
    bare = F.regexp_replace(d, r"\+", "")
    rest = (
        F.when(d.startswith("+90"), F.substring(d, 4, 64))
        .when(bare.startswith("0090"), F.substring(bare, 5, 64))
        .when(bare.startswith("90") & (F.length(bare) == 12), F.substring(bare, 3, 64))
        .when(bare.startswith("0") & (F.length(bare) == 11), F.substring(bare, 2, 64))
        .otherwise(bare)
    )
    return F.concat(F.lit("+90"), rest)


def plate(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, r"[\s.-]+", ""))


def plate_spaced(x: Column) -> Column:
    """Province, letters and digits, one space apart."""
    return F.upper(F.regexp_replace(x, r"^([0-9]{2})[\s-]*([A-Za-z]{1,3})[\s-]*([0-9]{2,4})$", "$1 $2 $3"))


def compact(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", "")
