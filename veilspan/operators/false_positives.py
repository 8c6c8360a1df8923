"""Candidates that are legal facts rather than personal data. Patterns are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import DELETED, normalise
from .detect import PLATE_BODY

#: Only broad types can be dropped, never identifiers.
BROAD = ("KISI", "DOGUM_TARIHI", "DIGER_KISISEL", "KONUM", "ADRES", "PLAKA", "BANKA", "CEZA_BILGISI")
_UNIT = r"[0-9]+(?:[.,][0-9]+)?\s+(?:yıl|sene|ay|hafta|gün|saat|dakika|saniye)(?:lık|lik|luk|lük)?"
DURATION = rf"^{_UNIT}(?:\s*(?:,|ve|ile)?\s*{_UNIT})*$"
DATE = r"^(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}\s+(?:ocak|şubat|mart|nisan|mayıs|haziran|temmuz|ağustos|eylül|ekim|kasım|aralık)\s+(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2})$"
BORN_BEFORE = r"(?:doğum(?:\s+tarihi(?:\s+ve\s+yeri)?|\s+yeri\s+ve\s+tarihi|\s+günü)?|d\.?\s*t(?:arihi)?\.?|doğdu(?:ğu)?)\s*[:=\-]?\s*$"
BORN_AFTER = r"^\s*(?:tarihinde\s+)?doğ(?:umlu|du|muş)"
NAMED = r"^(?:(?:türk\s+(?:borçlar|medeni|ceza|ticaret)|hukuk\s+muhakemeleri|ceza\s+muhakemesi|iş|icra\s+ve\s+iflas)\s+kanunu|anayasa|(?:(?:belirli|belirsiz)\s+süreli\s+)?(?:iş|kira|konut\s+kira|satış|taşınmaz\s+satış|hizmet|eser|vek[aâ]let|gizlilik|işbirliği)\s+sözleşmesi)$"

# An imperative that looks like a name, and the words before it.
IDIOM = r"(?iu)^h[aâ]le\s+get[iİı]r(?:[iİı]n(?:[iİı]z)?)?$"
MODIFIER = r"(?iu)(?:^|\s)(?:sağlam|hukuki|uygun|anlaşılır|okunabilir|tutarlı|güçlü|güvenli|hazır|sade|net|düzenli|iyi|bu|aynı)\s+$"


def _fold(x: Column) -> Column:
    return F.lower(F.translate(x, "İI", "iı"))


def legal_fact(text: Column, start: Column, end: Column, entity_type: Column) -> Column:
    """Durations, dates that are no dates of birth, statutes and contracts; windows of 100 and 40 code points."""
    value = _fold(F.trim(F.substring(text, start + 1, end - start)))
    before = _fold(F.substring(text, F.greatest(start - 99, F.lit(1)), F.least(start, F.lit(100))))
    after = _fold(F.substring(text, end + 1, F.lit(40)))
    date = value.rlike(DATE) & ~before.rlike(BORN_BEFORE) & ~after.rlike(BORN_AFTER)
    return entity_type.isin(*BROAD) & (value.rlike(DURATION) | date | value.rlike(NAMED))


def dropped(text: Column, c: Column) -> Column:
    return legal_fact(text, c["start"], c["end"], c["entity_type"])


def mistake(text: Column, start: Column, end: Column, entity_type: Column, plates: Column) -> Column:
    """An imperative taken for a name, or a plate's shape that the plate pattern (its matches: ``plates``) does not accept."""
    value = F.substring(text, start + 1, end - start)
    before = F.substring(text, F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40)))
    idiom = (entity_type == "KISI") & value.rlike(IDIOM) & before.rlike(MODIFIER)
    known = F.exists(plates, lambda p: (p["start"] == start) & (p["end"] == end))
    even = ~text.rlike(f"[{DELETED}]|\r\n")  # elsewhere positions may differ, and the span stays
    return idiom | ((entity_type == "PLAKA") & even & normalise(value).rlike(f"^{PLATE_BODY}$") & ~known)
