"""Personal data by a semi-Markov conditional random field over base patterns.

Base patterns (email, ip, card, phone) are found exactly, leftmost and without overlap per kind. The field
adds spans that they miss: numbers written without a plus sign, spelled-out or bracketed e-mail addresses,
cards with other separators. It scores whole candidate segments (shape, digit counts, checksum, separators,
neighbouring words) and picks boundaries and types together by dynamic programming over segments of at most
MAX_TOKENS tokens. Only stretches around digits and at-signs can hold a segment; everywhere else the best
path is outside. It is trained by gradient ascent on the exact conditional likelihood (forward and backward
sums over all segmentations) of generated sentences, with a fixed seed. A span of the field that meets a base
span is left out, so base spans always stay as they are.

Edge cases: a null text counts as empty and has no spans; null ids are passed through; repeated rows give
repeated results; long runs of one character cost linear time; an empty table gives an empty result. Only
the columns named are read, so further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import changed_texts, map_slices, table

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 20
CONTEXT = 6
WEIGHTS = 1 << 13

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), by start, then kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                out.append((*m.span(), 1))
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), 2))
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_|\d")
TRIGGER = re.compile(r"[0-9]{2,}|@|[\[({<]\s?(?:at|AT)\s?[\])}>]|\b(?:at|AT)\b(?=[^\n]{1,40}\b(?:dot|DOT)\b)")
NUMERIC = re.compile(r"[+(]?[0-9][0-9 ().,/-]*")
ATWORD = re.compile(r"@|[\[({<]\s?(?:at|AT)\s?[\])}>]|\s(?:at|AT)\s")
DOTWORD = re.compile(r"\.|[\[({<]\s?(?:dot|DOT)\s?[\])}>]|\s(?:dot|DOT)\s")
ADDRESS = re.compile(r"[A-Za-z0-9][\w.%+-]*\s?(?:@|[\[({<]\s?(?:at|AT)\s?[\])}>]|\s(?:at|AT)\s)\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[({<]\s?(?:dot|DOT)\s?[\])}>]|\s(?:dot|DOT)\s)\s?[A-Za-z0-9-]+)+")
PHONE_SHAPE = re.compile(r"(?:\(\d{2,4}\)|\d{2,5})(?:[ .-]{1,2}\d{2,5}){1,4}")
DATE_SHAPE = re.compile(r"(?:\d{4}[./-]\d{1,2}[./-]\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4})")
CUES = {w: k for k, ws in {"mail": "email mail e contact write", "phone": "phone tel telephone call fax mobile cell dial", "card": "card visa mastercard credit payment", "ip": "ip host address server", "count": "order invoice id no number page version isbn total of"}.items() for w in ws.split()}


def shape(s: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 5)}", s)
    s = re.sub(r"[^\W\d_]+", "a", s)
    return re.sub(r"\s+", " ", s)[:24]


class Stretch:
    """Tokens of a stretch and the segments that may carry a kind, with their features."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.text, self.tokens = text, tokens

    @functools.cached_property
    def segments(self) -> list[tuple[int, int, np.ndarray]]:
        return list(self.each())

    def each(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Token start, end (exclusive) and feature hashes of every segment, one at a time: a stretch may be long."""
        text, tokens = self.text, self.tokens
        n = len(tokens)
        for i in range(n):
            a = tokens[i][0]
            first = text[a]
            if not (first.isalnum() or first in "+(") or (a and first.isalnum() and (text[a - 1].isalnum() or text[a - 1] == "_")):
                continue
            for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                b = tokens[j - 1][1]
                if not text[b - 1].isalnum() or (b < len(text) and (text[b].isalnum() or text[b] == "_")):
                    continue
                s = text[a:b]
                if "\n" in s:
                    break
                if NUMERIC.fullmatch(s):
                    groups = re.findall("[0-9]+", s)
                    if (digits := sum(map(len, groups))) > 20 or len(groups) > 7:
                        break  # no kind is that long
                    if digits < 7:
                        continue
                elif not (ATWORD.search(s) and DOTWORD.search(s)):
                    continue
                yield i, j, self.of(text, s, a, b, i, j)

    def of(self, text: str, s: str, a: int, b: int, i: int, j: int) -> np.ndarray:
        digits = "".join(c for c in s if c.isdigit())
        marks = "".join(sorted({c for c in s if not c.isalnum()}))
        before = [text[x:y].lower() for x, y in self.tokens[max(0, i - 3) : i]]
        cues = sorted({CUES[w] for w in before if w in CUES})
        parts = s.split(".")
        f = [
            "bias", f"shape={shape(s)}", f"digits={len(digits)}", f"marks={marks}", f"n={min(j - i, 9)}", f"first={'d' if s[0].isdigit() else 'a' if s[0].isalpha() else s[0]}",
            f"address={bool(ADDRESS.fullmatch(s))}", f"phone={bool(PHONE_SHAPE.fullmatch(s))}", f"date={bool(DATE_SHAPE.fullmatch(s))}",
            f"quad={len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}",
            f"luhn={12 <= len(digits) <= 19 and not s.count('.') and luhn(digits)}", f"card={len(digits)}:{len(digits) >= 12 and luhn(digits)}",
            f"left={text[a - 1] if a and not text[a - 1].isspace() else ' '}", f"right={text[b] if b < len(text) and not text[b].isspace() else ' '}",
            f"next={text[b : b + 2] if b < len(text) and text[b] in '.-@/' else ''}", f"groups={min(len(re.findall('[0-9]+', s)), 6)}:{len(digits)}",
        ]
        f += [f"cue={c}" for c in cues] or ["cue=none"]
        return np.fromiter((zlib.crc32(x.encode()) % WEIGHTS for x in f), np.int64, len(f))


def stretches(text: str) -> list[Stretch]:
    """The stretches of tokens around triggers; they lie apart, however long one gets, so no segment crosses two."""
    if not (marks := [m.span() for m in TRIGGER.finditer(text)]):
        return []
    out, lo, hi = [], None, None
    reach = 24 * CONTEXT
    for a, b in marks:
        a0, b0 = max(0, a - reach), min(len(text), b + reach)
        if hi is not None and a0 <= hi:
            hi = max(hi, b0)
            continue
        if hi is not None:
            out.append((lo, hi))
        lo, hi = a0, b0
    out.append((lo, hi))
    return [Stretch(text, [m.span() for m in TOKEN.finditer(text, a, b)]) for a, b in out]


class SemiCrf:
    def __init__(self):
        self.w = np.zeros((len(KINDS), WEIGHTS))

    def score(self, features: np.ndarray) -> np.ndarray:
        return self.w[:, features].sum(1)

    def scores(self, x: Stretch) -> list[np.ndarray]:
        return [self.score(f) for _, _, f in x.segments]

    def best(self, x: Stretch) -> list[tuple[int, int, int]]:
        """(token start, token end, kind) of the best segmentation; outside tokens score zero."""
        n, ending = len(x.tokens), {}
        for i, j, f in x.each():
            s = self.score(f)
            k = int(np.argmax(s))
            if s[k] > 0:
                ending.setdefault(j, []).append((i, k, float(s[k])))
        if not ending:
            return []
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for i, k, s in ending.get(j, ()):
                if value[i] + s > value[j]:
                    value[j], back[j] = value[i] + s, (i, k)
        out, j = [], n
        while j > 0:
            if back[j]:
                out.append((back[j][0], j, back[j][1]))
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def gradient(self, x: Stretch, truth: set[tuple[int, int, int]], into: np.ndarray) -> None:
        """Adds observed less expected features of one stretch."""
        n, scores = len(x.tokens), self.scores(x)
        ending, starting = {}, {}
        for q, (i, j, _) in enumerate(x.segments):
            ending.setdefault(j, []).append(q)
            starting.setdefault(i, []).append(q)
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        for j in range(1, n + 1):
            alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[x.segments[q][0]] + np.logaddexp.reduce(scores[q]) for q in ending.get(j, ()))])
        for i in range(n - 1, -1, -1):
            beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[x.segments[q][1]] + np.logaddexp.reduce(scores[q]) for q in starting.get(i, ()))])
        for q, (i, j, f) in enumerate(x.segments):
            expected = np.exp(np.minimum(0.0, alpha[i] + scores[q] + beta[j] - alpha[n]))
            for k in range(len(KINDS)):
                if (d := ((i, j, k) in truth) - expected[k]) and abs(d) > 1e-6:
                    np.add.at(into[k], f, d)


def sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated training sentences with their spans: data in many spellings, and numbers that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwxyz") for _ in range(r.randint(2, 9)))

    def email() -> str:
        name = r.choice([word(), f"{word()}.{word()}", f"{word()}{d(2)}", f"{word()}_{word()}", f"{word()}.{d(2)}"])
        host, tld = r.choice([word(), f"mail{d(1)}", f"{word()}-{word()}"]), r.choice(["com", "org", "net", "de", "fr", "es", "co"])
        at, dot = r.choice([("@", "."), (" [at] ", "."), (" (at) ", "."), (" at ", " dot "), (" [at] ", " [dot] "), (" AT ", " DOT "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", ".")])
        return f"{name}{at}{host}{dot}{r.choice(['example' + dot, ''])}{tld}"

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) 555-{c}", f"{a}-555-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"00{d(2)} {a} {b} {c}", f"0{d(2)} {d(4)} {c}", f"({a}){b}-{c}", f"00{d(2)} {d(2)} {b} {d(2)} {d(2)}"])

    def card() -> str:
        x = r.choice("3456") + d(14)
        x += next(c for c in "0123456789" if luhn(x + c))
        sep = r.choice(["", " ", "-", ".", " - "])
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def other() -> str:
        x = r.choice("123456789") + d(15)
        bad = x[:-1] + next(c for c in "0123456789" if not luhn(x[:-1] + c))
        return r.choice([f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{d(2)}", f"{d(3)},{d(3)},{d(3)}", f"{d(4)}.{d(4)}", f"{r.randint(1, 9)}.{d(1)}.{d(2)}", f"{d(7)}", f"{d(10)}", f"{d(13)}", bad, bad, " ".join(bad[i : i + 4] for i in range(0, 16, 4)), f"{d(4)}-{d(4)}", f"{d(2)}:{d(2)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(3)}.{d(3)}.{d(3)}.{d(3)}.{d(2)}", f"20{d(2)} 20{d(2)} 20{d(2)}", f"{d(3)} {d(3)} {d(3)} {d(3)} {d(3)}", f"at {word()} dot {word()}", f"{word()} at {word()}. {word().capitalize()} {d(8)}", f'token = "{d(4)}{word()}{d(8)}{word()}{d(3)}"', f"{d(2)} {d(2)} {d(2)} {d(2)}"])

    kinds = [email, ip, card, phone]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(0, 4))).capitalize()
            text += r.choice([" ", "  ", ", ", ": ", ". "]) if text else ""
            kind = r.randrange(7)
            if kind < 4:
                cue = r.choice({0: ["email: ", "write to ", "contact "], 1: ["ip ", "host ", ""], 2: ["card ", "visa: ", ""], 3: ["tel ", "call ", "phone: "]}[kind]) if r.random() < 0.4 else ""
                s = kinds[kind]()
                text += cue
                spans.append((len(text), len(text) + len(s), kind))
                text += s
            else:
                text += (r.choice(["order ", "invoice ", "page ", "no "]) if r.random() < 0.3 else "") + other()
            text += r.choice([" ", ". ", ", ", ";\n", ") ", " "])
        out.append((text + " ".join(word() for _ in range(3)), spans))
    return out


@functools.cache
def trained(n: int = 700, epochs: int = 5, seed: int = 5) -> SemiCrf:
    crf, grads = SemiCrf(), np.full((len(KINDS), WEIGHTS), 1e-2)
    data = []
    for text, spans in sentences(n, seed):
        for x in stretches(text):
            starts, ends = {a: i for i, (a, _) in enumerate(x.tokens)}, {b: i + 1 for i, (_, b) in enumerate(x.tokens)}
            data.append((x, {(starts[a], ends[b], k) for a, b, k in spans if a in starts and b in ends}))
    for epoch in range(epochs):
        order = np.random.default_rng(seed + epoch).permutation(len(data))
        for lo in range(0, len(order), 16):
            g = -1e-3 * crf.w
            for q in order[lo : lo + 16]:
                crf.gradient(*data[q], g)
            grads += g * g
            crf.w += 0.3 * g / np.sqrt(grads)
    return crf


def all_spans(text: str, crf: SemiCrf) -> tuple[list, list]:
    """The base spans, and all spans."""
    base = base_spans(text)
    spans = list(base)
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    for x in stretches(text):  # stretches are apart, and so are the segments of one
        for i, j, k in crf.best(x):
            a, b = x.tokens[i][0], x.tokens[j - 1][1]
            if not (q := bisect_left(starts, b)) or ends[q - 1] <= a:
                spans.append((a, b, k))
    return base, sorted(spans, key=lambda s: (s[0], s[2]))


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, crf: SemiCrf | None = None) -> DataFrame:
    """A row of SCHEMA per row of ``docs``; counts are of base spans, ``spans`` holds all."""
    held = docs.sparkSession.sparkContext.broadcast((crf or trained()).w)

    def run(part: dict) -> dict:
        own = SemiCrf()
        own.w = held.value
        rows = []
        for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
            base, spans = all_spans(text.decode(), own)
            counts = [sum(k == q for _, _, k in base) for q in range(len(KINDS))]
            rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return dict(zip([f.split()[0] for f in SCHEMA.split(", ")], zip(*rows, strict=True), strict=True))

    return map_slices(docs.select("doc_id", "text"), run, SCHEMA)


def redact_pii(docs: DataFrame, crf: SemiCrf | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; a null text stays null."""
    held = docs.sparkSession.sparkContext.broadcast((crf or trained()).w)

    def clean(text: str) -> str:
        own = SemiCrf()
        own.w = held.value
        out, at = [], 0
        for a, b, k in all_spans(text, own)[1]:
            if b > at:  # overlapping spans of several kinds go as one
                if a >= at:
                    out += [text[at:a], f"<{KINDS[k].upper()}>"]
                at = b
        return "".join([*out, text[at:]])

    return changed_texts(docs, clean)


def op3_semi_markov_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
