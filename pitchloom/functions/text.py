"""Text expressions that stay inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: Latin letters that don't decompose, and how names without accents spell them ---
UNDECOMPOSED = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i", "ħ": "h", "Ħ": "H"}
SPELLED_OUT = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH"}
# --- end of fixed values ---


@cache
def accents() -> tuple[str, str]:
    """By rule: every letter that decomposes to an ASCII letter and marks, and that letter."""
    pairs = {}
    for code in range(0xC0, 0x3000):
        parts = unicodedata.normalize("NFD", chr(code))
        if parts != chr(code) and parts[0].isascii():
            pairs[chr(code)] = parts[0]
    return "".join(pairs), "".join(pairs.values())


def plain_ascii(text: Column) -> Column:
    """Accents taken off, special letters spelled out; other scripts stay."""
    source, target = accents()
    out = F.translate(text, source + "".join(UNDECOMPOSED), target + "".join(UNDECOMPOSED.values()))
    for a, b in SPELLED_OUT.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"\p{Mn}+", "")


def name_norm(text: Column) -> Column:
    """Accents off, lower case, anything but a-z and 0-9 becomes one space; null stays null."""
    return F.trim(F.regexp_replace(F.lower(plain_ascii(text)), "[^a-z0-9]+", " "))


def null_if_sentinel(text: Column, *sentinels: str) -> Column:
    """Null for texts that stand for null ("" and "null" by default), spaces around them ignored."""
    marks = sentinels or ("", "null")
    return F.when(~F.lower(F.trim(text)).isin(*marks), text)
