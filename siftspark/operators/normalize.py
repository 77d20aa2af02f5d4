"""Normalisation: one text for all spellings of it, so that detectors see what a reader sees.

NFKC, then, word by word: invisible characters are dropped, typographic blanks, quotes and
dashes become ASCII, and look-alikes become ASCII where the word poses as a Latin one.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftspark.functions.confusables import confusables

PUNCTUATION = dict.fromkeys("\u2018\u2019\u201a\u201b", "'") | dict.fromkeys("\u201c\u201d\u201e\u201f", '"') | dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2212", "-")
# Scripts ordinary text is written in: words of one of them alone are never folded.
_COMMON = ("CYRILLIC ", "GREEK ", "ARMENIAN ", "HEBREW ", "ARABIC ", "EXTENDED ARABIC", "DEVANAGARI ", "BENGALI ", "THAI ", "GEORGIAN ", "CJK ", "IDEOGRAPHIC ", "HIRAGANA ", "KATAKANA", "HANGUL ")
_WORD = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@lru_cache(maxsize=1 << 16)
def invisible(c: str) -> bool:
    """Whether a character has no glyph: of category Cf, a variation selector or a tag."""
    return unicodedata.category(c) == "Cf" or "\ufe00" <= c <= "\ufe0f" or "\U000e0000" <= c <= "\U000e007f" or c == "\u180e"


@lru_cache(maxsize=1 << 16)
def script(c: str) -> str:
    """Of a letter or digit latin, common or rare; of all else the empty text."""
    kind = unicodedata.category(c)
    if kind[0] != "L" and kind != "Nd":
        return ""
    if c.isascii():
        return "latin"
    name = unicodedata.name(c, "")
    return "latin" if name.startswith("LATIN ") else "common" if name.startswith(_COMMON) else "rare"


def should_fold(word: str) -> bool:
    """Whether a word poses as Latin: it mixes Latin with another script, or is of one nobody writes prose in."""
    scripts = {script(c) for c in word}
    return "rare" in scripts or {"latin", "common"} <= scripts


def mixed_script(word: str) -> bool:
    """Whether a word has Latin letters and others."""
    kinds = {script(c) == "latin" for c in word if c.isalpha()}
    return len(kinds) == 2


def _folded(m: re.Match) -> str:
    word = m[0]
    if word.isascii():
        return word
    alike = confusables() if should_fold(word) else {}
    return "".join(PUNCTUATION.get(c) or alike.get(c, c) for c in word if not invisible(c))


def normalized(text: str | None) -> str | None:
    """The canonical form of a text; null for null."""
    if not text or text.isascii():
        return text
    return _WORD.sub(_folded, unicodedata.normalize("NFKC", text))


@F.arrow_udf(StringType())
def _normalized(texts: pa.Array) -> pa.Array:
    return pa.array([normalized(v.as_py()) for v in texts], pa.string())


def normalize(text: Column) -> Column:
    """The canonical form of each text. ASCII texts are their own and stay in the JVM's hands."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, text).otherwise(_normalized(F.when(~plain, text)))
