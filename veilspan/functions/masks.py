"""Masks and tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import digits


def asterisk(x: Column) -> Column:
    """Every character but ASCII white space becomes a star."""
    return F.regexp_replace(x, r"[^ \t\n\x0B\f\r]", "*")


def label(entity_type: Column) -> Column:
    return F.concat(F.lit("["), entity_type, F.lit("]"))


def _cut(x: Column, a: int, stars: str, z: int) -> Column:
    return F.concat(F.substring(x, 1, a), F.lit(stars), F.right(x, F.lit(z)))


def generic(x: Column) -> Column:
    return F.when(F.length(x) <= 3, F.repeat(F.lit("*"), F.length(x))).otherwise(_cut(x, 1, "***", 1))


def _email(x: Column) -> Column:
    user, n = F.substring_index(x, "@", 1), F.length(F.substring_index(x, "@", 1))
    short = F.when(n <= 1, F.lit("*")).when(n == 2, F.concat(F.substring(user, 1, 1), F.lit("*"))).otherwise(_cut(user, 1, "***", 1))
    return F.when(F.locate("@", x) > 0, F.concat(short, F.substring(x, n + 1, F.length(x)))).otherwise(generic(x))


def _phone(x: Column) -> Column:
    d = digits(x)
    core, n = F.right(d, F.lit(10)), F.length(d)
    prefix = F.when(n <= 10, "").when((n == 12) & d.startswith("90"), "+90 ").otherwise("0")
    return F.when(n >= 10, F.concat(prefix, F.substring(core, 1, 3), F.lit(" *** ** "), F.right(core, F.lit(2)))).otherwise(generic(x))


def _name(x: Column) -> Column:
    words = F.filter(F.split(F.trim(x), r"(?U)\s+"), lambda w: w != "")
    hidden = F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.repeat(F.lit("*"), F.length(w) - 1)))
    return F.when(F.size(words) > 0, F.array_join(hidden, " ")).otherwise("***")


def _plate(x: Column) -> Column:
    parts = F.split(F.trim(x), r"(?U)\s+")
    return F.when(F.size(parts) >= 2, F.concat(F.element_at(parts, 1), F.lit(" *** "), F.element_at(parts, -1))).otherwise(generic(x))


def partial(x: Column, entity_type: Column | str) -> Column:
    """A mask that stays readable, by type; a type known beforehand builds its own mask only."""
    d, flat = digits(x), F.upper(F.regexp_replace(x, r"\s+", ""))
    by = {
        "TCKN": F.when(F.length(d) == 11, _cut(d, 3, "*****", 3)),
        "VKN": F.when(F.length(d) == 10, _cut(d, 3, "****", 3)),
        "IBAN": F.when(flat.startswith("TR") & (F.length(flat) == 26), _cut(flat, 4, " **** **** **** **** **** ", 2)),
        "TELEFON": _phone(x),
        "EPOSTA": _email(x),
        "KISI": _name(x),
        "KREDI_KARTI": F.when(F.length(d) >= 12, F.concat(F.lit("**** **** **** "), F.right(d, F.lit(4)))),
        "PLAKA": _plate(x),
        "MERSIS": F.when(F.length(d) == 16, _cut(d, 4, "********", 4)),
        "IP_ADRESI": F.when(F.size(F.split(x, r"\.")) == 4, F.concat(F.substring_index(x, ".", 2), F.lit(".*.*"))),
        "ADRES": F.when(F.length(x) <= 10, F.lit("***")).otherwise(F.concat(F.substring(x, 1, 8), F.lit("... [Adres Gizlendi]"))),
    }
    legal = F.regexp_extract(x, r"([0-9]{4})[/-][0-9]+", 1)
    by |= {t: F.when(legal != "", F.concat(legal, F.lit("/****"))) for t in ("ESAS_NO", "KARAR_NO", "DOSYA_NO")}
    if isinstance(entity_type, str):
        return F.coalesce(by[entity_type], generic(x)) if entity_type in by else generic(x)
    chain = None
    for t, mask in by.items():
        chain = F.when(entity_type == t, mask) if chain is None else chain.when(entity_type == t, mask)
    return F.coalesce(chain, generic(x))


def token(session: Column | None, entity_type: Column, index: Column) -> Column:
    """With a session a namespaced token, without one the legacy form."""
    if session is None:
        return F.concat(F.lit("["), entity_type, F.lit("_"), index.cast("string"), F.lit("]"))
    return F.concat(F.lit("⟦RDT:"), session, F.lit(":"), entity_type, F.lit(":"), index.cast("string"), F.lit("⟧"))
