"""Names and addresses, which need scans over words: one Arrow function over the normalised text.

Patterns, word lists, confidences and priorities are fixed values that results depend on. The dictionary of first
names is a parameter; the default holds frequent Turkish first names only. Null texts give null.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from .detect import CANDIDATE

# Words before a name.
ROLES = ("Davacı", "Davalı", "Müşteki", "Sanık", "Şüpheli", "Mağdur", "Katılan", "Müdahil", "Tanık", "Mirasçı", "Müvekkil", "Borçlu", "Alacaklı", "İhbar Olunan", "Vasi", "Kayyım", "Kiracı", "Kiraya Veren", "Müteahhit", "İşveren", "İşçi", "Taraf", "Başvuran", "İtiraz Eden")
TITLES = (r"Av\.", "Avukat", "Hakim", "Hâkim", "Savcı", r"Dr\.", "Doktor", r"Prof\.\s*Dr\.", r"Doç\.\s*Dr\.", "Bilirkişi", "Noter", "Uzman")
LABELS = (r"Adı\s+Soyadı", r"Ad\s+Soyad", r"İsim\s+Soyisim", "İsim", "Adı", "Vekili", "Müdafii", "İmza", "İmzası", "Yetkili")
SALUTATIONS = ("Sayın", r"Sn\.")
# Words that make a run of capitalised words an institution.
INSTITUTION = frozenset(
    "mahkemesi mahkeme başsavcılığı başsavcılık savcılığı dairesi müdürlüğü müdürlük bakanlığı bakanlık başkanlığı başkanlık valiliği valilik kaymakamlığı "
    "belediyesi belediye üniversitesi fakültesi enstitüsü hastanesi şirketi şirket holding kurumu kurul kurulu kulübü derneği vakfı komisyonu partisi bankası "
    "gazetesi kanunu tüzüğü yönetmeliği maddesi fıkrası sayılı kararı tarihli bölge asliye sulh ağır komutanlığı emniyet jandarma".split()
)
# Capitalised words that are no first names, and phrases that are no names.
NO_NAME = frozenset("türkiye istanbul ankara izmir bursa antalya adana bu şu o her bir tüm bütün sayfa konu özet hüküm talep karar sonuç gerekçe dosya tarih ek iç dış kamu özel genel resmi".split())
PHRASES = ("türk ceza kanunu", "ceza muhakemesi kanunu", "hukuk muhakemeleri kanunu", "borçlar kanunu", "icra iflas kanunu", "iş kanunu", "medeni kanun", "yargıtay", "danıştay", "anayasa mahkemesi", "bölge adliye mahkemesi", "asliye ceza", "asliye hukuk", "sulh ceza", "sulh hukuk", "ağır ceza")
#: Default dictionary; pass a longer one for production.
FIRST_NAMES = frozenset(
    "ahmet ali ayşe fatma mehmet mustafa emine hatice zeynep elif hasan hüseyin ibrahim ismail osman yusuf murat ömer emre can cem burak kemal orhan serkan "
    "tolga volkan yasin zafer ebru pınar canan sevgi selin deniz derya esra gamze gül gülay hale hülya ipek jale kübra leyla meryem merve nur özlem pelin "
    "sema sibel şule tuğba yasemin yıldız zehra arda barış berk cihan doğan engin erdem erkan fatih furkan gökhan hakan halil kaan kerem levent metin onur "
    "okan ozan recep salih selim sinan süleyman taner turgut ufuk umut veli yavuz".split()
)

_NAME = r"(?P<name>(?-i:\p{Lu}(?:\p{L}+|\.)(?:\s+(?:\p{Lu}\p{L}+|\p{Lu}\.)){1,3}))(?:'\p{L}+)?"
_COURT = r"(?!\s+(?:Mahkemesi|Başsavcılığı|Dairesi|Müdürlüğü|{}Kanunu))"


def _compiled() -> tuple:
    """(pattern, priority, whether its word is a label)."""
    one = lambda words: "(?:" + "|".join(words) + ")"
    shapes = (
        (rf"\b{one(LABELS)}\s*[:\-/]\s*(?:Av\.\s*)?{_NAME}\b", 96, True),
        (rf"\b(?:Davacı\s+|Davalı\s+)?{one(ROLES)}(?:[ıi]m|[ıi]|imiz)?(?:\s+müvekkil(?:im|i|imiz)?)?\s*[:\-/]?\s+(?:Av\.\s*)?{_NAME}{_COURT.format('Bakanlığı|')}\b", 93, False),
        (rf"\b{one(TITLES)}\s+{_NAME}{_COURT.format('')}\b", 92, False),
        (rf"\b{one(SALUTATIONS)}\s+{_NAME}\b", 90, False),
    )
    return tuple((regex.compile(p, regex.I), priority, label) for p, priority, label in shapes)


_CONTEXT = _compiled()
_RUN = regex.compile(r"\b\p{Lu}\p{L}*(?:'\p{L}+)?\b(?: \p{Lu}\p{L}*(?:'\p{L}+)?\b)+")
_IDIOM = regex.compile(r"h[aâ]le\s+get[iİı]r(?:[iİı]n(?:[iİı]z)?)?", regex.I)
_MODIFIER = regex.compile(r"(?:\A|\s)(?:sağlam|hukuki|uygun|anlaşılır|okunabilir|tutarlı|güçlü|güvenli|hazır|sade|net|düzenli|iyi|bu|aynı)\s+\Z", regex.I)
_ADDRESS = regex.compile(r"\b(?:Tebligat\s+)?(?:İkametg[aâ]h|Adres(?:i)?)\s*[:\-/]\s*(?P<address>[^\r\n]{10,180})(?:\r?\n|$)", regex.I)
_FIELD = regex.compile(r"\b(?:TCKN|T\.?C\.?|VKN|Vergi|Tel(?:efon)?|GSM|E-?posta|IBAN|MERS[İI]S|Dosya\s*No|Esas\s*No)\s*[:\-/]", regex.I)
_WORDS = r"A-Za-zÇĞİÖŞÜçğıöşü0-9\s.\-"
_STRETCH = regex.compile(f"[{_WORDS}]+")
_PARTS = regex.compile(rf"\b[{_WORDS}]+Mah(?:allesi|\.)?\s*[{_WORDS}]+(?:Cad(?:desi|\.)?|Sok(?:ağı|\.)?|Blv\.?|Bulvarı)\s*(?:No|Daire|Kat|D|K)\s*[:.\-]?\s*\d+[A-Za-z]?(?:[{_WORDS}/,]+)?", regex.I)
_EDGE = regex.compile(r"\b")


def _row(start: int, value: str, kind: str, rule: str, confidence: float, labelled: bool, priority: int, bonus: int) -> dict:
    canonical = " ".join(value.split()).lower() if kind == "KISI" else value
    return {"start": start, "end": start + len(value), "value": value, "entity_type": kind, "canonical": canonical, "confidence": confidence, "rule_id": rule, "status": "not_checked", "labelled": labelled, "priority": priority, "bonus": bonus}


def _plain(name: str) -> bool:
    low = name.lower()
    return not any(p in low for p in PHRASES)


def contextual_names(text: str) -> list[dict]:
    """Two to four capitalised words or initials after a label, role, title or salutation."""
    out = []
    for pattern, priority, label in _CONTEXT:
        for m in pattern.finditer(text):
            if _plain(m["name"]):
                out.append(_row(m.start("name"), m["name"], "KISI", "NAME_CONTEXTUAL", 0.95, label, priority, 250))
    return out


def dictionary_names(text: str, names: frozenset[str]) -> list[dict]:
    """Runs of two to four words, one space apart, that begin with a first name and hold no institution's word."""
    out = []
    for run in _RUN.finditer(text):
        words = [(run.start() + w.start(), w.group().split("'")[0]) for w in regex.finditer(r"[^ ]+", run.group())]
        low = [w.lower() for _, w in words]
        i = 0
        while i < len(words) - 1:
            taken = words[i : i + 4]
            start, end = taken[0][0], taken[-1][0] + len(taken[-1][1])
            following = regex.match(r"\s+(\p{Lu}\p{L}+)", text[end : end + 40])
            inside = low[i : i + 4] + ([following[1].lower()] if following else [])
            if low[i] in names and low[i] not in NO_NAME and _plain(text[start:end]) and not INSTITUTION.intersection(inside):
                out.append(_row(start, text[start:end], "KISI", "NAME_GAZETTEER", 0.85, False, 65, 150))
                i += len(taken)
            else:
                i += 1
    return out


def addresses(text: str) -> list[dict]:
    """The rest of a line after an address label, up to the next field; and quarter, street and number together.

    The second pattern can start at the first word of a stretch of its characters or nowhere in it, so that it is
    tried once a stretch.
    """
    out = []
    for m in _ADDRESS.finditer(text):
        raw, start = m["address"], m.start("address")
        start, raw = start + len(raw) - len(raw.lstrip()), raw.strip()
        if cut := _FIELD.search(raw):
            raw = raw[: cut.start()].rstrip(" \t,.-/")
        if len(raw.encode()) >= 5:
            out.append(_row(start, raw, "ADRES", "ADDRESS_LABEL", 0.95, True, 85, 0))
    done = 0
    for stretch in _STRETCH.finditer(text):
        if stretch.start() < done or "mah" not in stretch.group().lower():
            continue
        edge = _EDGE.search(text, stretch.start())
        m = _PARTS.match(text, edge.start()) if edge else None
        if m:
            done = m.end()
            if len((raw := m.group().rstrip()).encode()) >= 15:
                out.append(_row(m.start(), raw, "ADRES", "ADDRESS_COMPONENTS", 0.75, False, 60, 0))
    return out


def _idiom(text: str, c: dict) -> bool:
    """An imperative that looks like a name, after its modifier."""
    return _IDIOM.fullmatch(c["value"]) is not None and _MODIFIER.search(text[max(0, c["start"] - 40) : c["start"]]) is not None


_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("entity_type", pa.string()), ("canonical", pa.string()), ("confidence", pa.float64()), ("rule_id", pa.string()), ("status", pa.string()), ("labelled", pa.bool_()), ("priority", pa.int32()), ("bonus", pa.int32())]))
_FOLD = ("İIı", "iii")


def _fold(word: str) -> str:
    return word.translate(str.maketrans(*_FOLD)).lower()


#: The longest literal part of each word before a name, folded.
_SIGNS = tuple(sorted({max((_fold(x) for x in regex.split(r"\\s[+*]|\s+", w.replace(r"\.", "."))), key=len) for w in ROLES + TITLES + LABELS + SALUTATIONS}))
_PAIR = r"\p{Lu}(?:\p{L}+|\.)\s+\p{Lu}"
_RUN_PAIR = r"\p{Lu}\p{L}*(?:'\p{L}+)? \p{Lu}"
#: Beyond so many first names two capitalised words are the sign of one.
_LISTED = 400


def signs(text: Column, kind: str, names: frozenset[str], dictionary: bool) -> Column:
    """False for texts that surely hold no name or address; these do not leave the JVM."""
    if kind == "ADRES":
        return text.rlike("(?iu)adres|ikametg|mah")
    folded = F.lower(F.translate(text, *_FOLD))
    context = F.when(text.rlike(_PAIR), let(folded, lambda low: reduce(or_, (low.contains(w) for w in _SIGNS))))
    listed = F.lit(False)
    if dictionary:
        any_i = str.maketrans({c: "[iıIİ]" for c in "iıIİ"})
        words = "|".join(sorted(n.translate(any_i) for n in names if n.isalpha())) if len(names) <= _LISTED else r"\p{L}+"
        listed = F.when(text.rlike(_RUN_PAIR), text.rlike(rf"(?=\p{{Lu}})(?iu:{words or '(?!)'})(?:'\p{{L}}+)? \p{{Lu}}"))
    return F.when(context, True).otherwise(F.coalesce(listed, F.lit(False)))


def contextual(text: Column, kinds: tuple[str, ...], names: frozenset[str] = FIRST_NAMES, dictionary: bool = True) -> Column:
    """Candidates of the kinds (KISI, ADRES); null where the text has no trigger."""

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            found: list[dict] = []
            if t is not None and "KISI" in kinds:
                found += contextual_names(t) + (dictionary_names(t, names) if dictionary else [])
                found = [c for c in found if not _idiom(t, c)]
            if t is not None and "ADRES" in kinds:
                found += addresses(t)
            rows.append(found if t is not None else None)
        return pa.array(rows, type=_TYPE)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    scan = F.arrow_udf(run, CANDIDATE)
    triggered = None
    for k in kinds:
        sign = signs(text, k, names, dictionary)
        triggered = sign if triggered is None else triggered | sign
    return scan.asNondeterministic()(F.when(triggered, text))
