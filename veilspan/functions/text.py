"""Text normalisation and match positions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are deleted, become a space, or become a plain quote.
DELETED = "\u00ad\u200b\u200c\u200d\ufeff"
SPACES = "\u00a0\u202f\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u3000"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b\u02bc"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f"


def normalise(text: Column) -> Column:
    """Deletes invisible characters, evens out spaces and quotes, and makes every line end one line feed."""
    mapped = SPACES + SINGLE_QUOTES + DOUBLE_QUOTES
    to = " " * len(SPACES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES)
    clean = F.regexp_replace(F.translate(text, mapped + DELETED, to), "\r\n?", "\n")
    return F.when(text.rlike(f"[{mapped}{DELETED}\r]"), clean).otherwise(text)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside lambda functions."""
    return F.transform(F.array(value), body)[0]


#: Lengths that are added one by one; what comes before goes by sums of whole blocks.
_BLOCK = 128
_MATCHES = "array<struct<start:int,end:int,value:string,before:string>>"
#: Characters of the gap before a match that are kept with it.
BEFORE = 40


def quoted(x: str) -> str:
    """A SQL string literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(text: str, pattern: str) -> Column:
    """array<struct<start,end,value,before>> of all matches in the column ``text``; positions are code points, ends exclusive; before is the end of the gap to the match before.

    The gaps between matches and the matches alternate, so their lengths add up to the positions: the sums of
    blocks of lengths, then the lengths since. Work grows with the matches, but for the sums of blocks. One SQL
    text instead of many column calls, since building those takes longer than many a query; ``transform(array(x), y
    -> ...)[0]`` names a value that is computed once.
    """
    t, p, total = f"`{text}`", quoted(pattern), lambda a: f"aggregate({a}, 0, (s, x) -> s + x)"
    at = f"get(before, cast(i div {_BLOCK} as int)) + {total(f'slice(lengths, cast(i div {_BLOCK} as int) * {_BLOCK} + 1, i % {_BLOCK} + 1)')}"
    located = f"transform(found, (m, i) -> transform(array({at}), e -> named_struct('start', e - length(m), 'end', e, 'value', m, 'before', right(get(gaps, i), {BEFORE})))[0])"
    for name, value in (
        ("before", f"transform(sums, (_, b) -> {total('slice(sums, 1, b)')})"),
        ("sums", f"transform(sequence(0, cast(floor(size(lengths) / {_BLOCK}) as int)), b -> {total(f'slice(lengths, b * {_BLOCK} + 1, {_BLOCK})')})"),
        ("lengths", "zip_with(slice(gaps, 1, size(found)), found, (g, m) -> length(g) + length(m))"),
        ("found", f"regexp_extract_all({t}, {quoted(f'({pattern})')}, 1)"),
        ("gaps", f"split({t}, {p}, -1)"),
    ):
        located = f"transform(array({value}), {name} -> {located})[0]"
    return F.expr(f"cast(case when {t} rlike {p} then {located} else array() end as {_MATCHES})")


def byte_offset(text: Column, position: Column) -> Column:
    """UTF-8 bytes before a code-point position."""
    return F.octet_length(F.substring(text, F.lit(1), position))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ('"', "&quot;"), ("'", "&#039;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
