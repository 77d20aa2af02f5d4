"""One form for texts that look the same but are made of different characters.

Only what the eye can't tell apart is unified: width of characters, way of composing
accents, invisible characters, kind of blank or hyphen, and letters of other scripts that
are drawn like Latin ones. Case, accents, size and height of signs (superscripts,
ligatures, fractions) and everything else stay.

Text that is already in this form is recognised by quick-check properties: a character
class of all code points that can change, or can compose with the character before. Only
the segments these are in are normalised, from the last stable starter before to the next
after, and spliced into the unchanged rest.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftspark.session import cut_lineage

# Letters of other scripts drawn like a Latin letter, by base letter (accents are taken off before).
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ү": "Y", "Һ": "h", "Ӏ": "I", "Ԁ": "d", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ꭓ": "X",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ӏ": "l", "ԁ": "d", "ԍ": "g", "ԛ": "q",
    "ԝ": "w", "ѵ": "v", "ү": "y", "Ԑ": "Ɛ", "Ә": "Ə", "ә": "ə", "Ӕ": "Æ", "ӕ": "æ",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "γ": "y",
    # Armenian
    "ո": "n", "ս": "u", "օ": "o", "հ": "h", "ց": "g", "յ": "j", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L", "Ս": "U",
    # Latin letters that are drawn like the plain ones
    "ɡ": "g", "ɑ": "a",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮖ": "I", "Ꮞ": "4", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W",
    "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B",
    # Coptic and Lisu
    "Ⲟ": "O", "ⲟ": "o", "Ⲥ": "C", "ⲥ": "c", "Ⲣ": "P", "ⲣ": "p", "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T", "Ⲭ": "X", "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T",
    "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y",
    "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}

#: Hyphens drawn like the hyphen-minus. Dashes and the minus sign are longer and stay.
HYPHENS = "‐‑﹣－⁃"

#: Characters of no width beside general category Cf: fillers, variation selectors, joiners of marks.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Signs of category Cf that are seen.
SEEN = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}

_JOINER, _EMOJI_STYLE, _TEXT_STYLE = 0x200D, 0xFE0F, 0xFE0E


def _invisible(c: int) -> bool:
    return c in INVISIBLE or (unicodedata.category(chr(c)) == "Cf" and c not in SEEN)


def _blank(c: int) -> bool:
    return c != 0x20 and c != 0x1680 and unicodedata.category(chr(c)) == "Zs"


#: Pictographs: joiners and style selectors between them are seen, as they join or recolour.
_PICTURES = r"\u00A9\u00AE\u203C\u2049\u2122\u2139\u2190-\u21FF\u2300-\u23FF\u24C2\u25A0-\u27BF\u2900-\u297F\u2B00-\u2BFF\u3030\u303D\u3297\u3299\U0001F000-\U0001FAFF"
_SEEN_JOINERS = re.compile(f"(?<=[{_PICTURES}\\uFE0F])\\u200D(?=[{_PICTURES}])|(?<=[{_PICTURES}])[\\uFE0E\\uFE0F]")


@lru_cache(1)
def _tables() -> tuple[dict[int, str], re.Pattern]:
    """What single characters become after decomposition, and the pattern of unstable segments."""
    single: dict[int, str] = {}
    unstable: list[int] = []
    for c in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xF8FF or 0x3400 <= c <= 0x4DBF or 0x4E00 <= c <= 0x9FFF or 0x20000 <= c <= 0x2F7FF or c > 0xE01EF:
            continue
        ch = chr(c)
        wide = unicodedata.decomposition(ch)
        if _invisible(c):
            single[c] = ""
        elif _blank(c):
            single[c] = " "
        elif ch in HYPHENS:
            single[c] = "-"
        elif wide.startswith(("<wide>", "<narrow>")):
            single[c] = "".join(chr(int(x, 16)) for x in wide.split()[1:])
        elif ch in LOOKALIKES and LOOKALIKES[ch] != ch:
            single[c] = LOOKALIKES[ch]
        # Quick check: what changes by itself, by decomposition, or can compose with what is before it.
        if c in single or unicodedata.combining(ch) or not unicodedata.is_normalized("NFC", ch) or _composes_back(c):
            unstable.append(c)
        elif any(ord(x) in single or x in LOOKALIKES for x in unicodedata.normalize("NFD", ch)):
            unstable.append(c)
    # What a wide form stands for may itself be a look-alike.
    for c, to in list(single.items()):
        single[c] = "".join(LOOKALIKES.get(x, x) for x in to)
    parts, start = [], None
    for a, b in zip(unstable, [*unstable[1:], None], strict=True):
        start = a if start is None else start
        if b != a + 1:
            parts.append(re.escape(chr(start)) + ("-" + re.escape(chr(a)) if a > start else ""))
            start = None
    return single, re.compile(f"[^{''.join(parts)}]?[{''.join(parts)}]+")


def _composes_back(c: int) -> bool:
    """NFC_Quick_Check=Maybe: Hangul vowels and final consonants, and marks (which are combining)."""
    return 0x1161 <= c <= 0x1175 or 0x11A8 <= c <= 0x11C2


def _segment(match: re.Match) -> str:
    text, start, end = match.string, match.start(), match.end()
    out = []
    if "\u200D" in match[0] or "\uFE0F" in match[0] or "\uFE0E" in match[0]:
        for seen in _SEEN_JOINERS.finditer(text, start):
            if seen.start() >= end:
                break
            out += [_normal(text[start : seen.start()]), seen[0]]
            start = seen.end()
    out.append(_normal(text[start:end]))
    return "".join(out)


def _normal(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_tables()[0]))


def one_form(text: str | None) -> str | None:
    """The one form of ``text``; null for null, and a text already in it comes back as it is."""
    if text is None or text.isascii():
        return text
    return _tables()[1].sub(_segment, text)


@F.arrow_udf(StringType())
def _one_form(texts: pa.Array) -> pa.Array:
    return pa.array([one_form(value.as_py()) for value in texts], pa.string())


def one_form_column(text: Column) -> Column:
    """The one form of each text. ASCII texts, which are in it, don't leave the JVM."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.coalesce(_one_form(F.when(~plain, text)), text)


def lookalike_classes(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each non-null field of each row: fld, key, value_hash, class.

    Equal ``class`` within a field means that the values read the same; equal value_hash
    that they are equal. Null fields give no row; empty texts and texts of nothing but
    invisible characters read the same; repeated rows give repeated rows; further columns are ignored.
    """
    melted = rows.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(f).alias("fld"), F.col(f).alias("value")) for f in fields])).alias("f")).select(
        "f.fld", key, F.col("f.value").alias("value")
    )
    melted = melted.where(F.col("value").isNotNull())
    return melted.select("fld", key, F.sha2("value", 256).alias("value_hash"), F.sha2(one_form_column(F.col("value")), 256).alias("class"))


def lookalike_class_sizes(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each class of a field: fld, class, variants (different values that read the same), members (rows).

    With :func:`lookalike_classes` (who is in which class) this is the whole result, linear in the rows however large a class is.
    Counted by partial aggregations, so a class of any size is no hot key. Null fields are in no class; an empty table gives none.
    """
    by_value = lookalike_classes(rows, key, fields).groupBy("fld", "class", "value_hash").agg(F.count(F.lit(1)).alias("n"))
    return by_value.groupBy("fld", "class").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("members"))


#: Rows with one value that one cell of the pair join takes; values with more are cut into several cells.
CELL = 20_000


def lookalike_pairs(rows: DataFrame, key: str, fields: list[str], cell: int = CELL) -> DataFrame:
    """Pairs of rows whose values in a field differ but read the same: fld, a, b (a < b), each once.

    Classes with one value only, however many copies it has, are left out by a partial
    aggregation before any join. Within the others, pairs of different values are joined to
    the rows that have them; rows with equal values never meet. Values with many rows are salted: the rows of a value are cut into cells
    of about ``cell``, and a pair of values becomes a grid of cells, so that no task takes all rows of a hot value.
    Null fields are in no pair; repeated rows count once; an empty table gives none.
    """
    packed = lambda c: F.unhex(F.substring(c, 1, 32)).alias(c)  # noqa: E731 - 128 of 256 bits
    classes = cut_lineage(lookalike_classes(rows, key, fields).select("fld", key, packed("value_hash"), packed("class")))
    by_value = classes.groupBy("fld", "class", "value_hash").agg(F.count(F.lit(1)).alias("n"))
    several = by_value.groupBy("fld", "class").agg(F.min("value_hash").alias("low"), F.max("value_hash").alias("high")).where("low <> high").select("fld", "class")
    variants = cut_lineage(by_value.join(several, ["fld", "class"]).select("fld", "class", "value_hash", F.ceil(F.col("n") / cell).cast("int").alias("cells")))
    x, y = (variants.withColumnsRenamed({"value_hash": v, "cells": f"__n{v}"}) for v in "xy")
    grid = (
        x.join(y, ["fld", "class"])
        .where("x < y")
        .select("fld", "class", "x", "y", "__ny", F.explode(F.sequence(F.lit(0), F.col("__nx") - 1)).alias("__i"))
        .select("fld", "class", "x", "y", "__i", F.explode(F.sequence(F.lit(0), F.col("__ny") - 1)).alias("__j"))
    )
    members = classes.join(variants, ["fld", "class", "value_hash"]).select("fld", "class", "value_hash", key, F.pmod(F.xxhash64(key), F.col("cells")).cast("int").alias("__cell"))
    left, right = (members.withColumnsRenamed({"value_hash": v, key: f"__{v}", "__cell": c}) for v, c in (("x", "__i"), ("y", "__j")))
    pairs = grid.join(left, ["fld", "class", "x", "__i"]).join(right, ["fld", "class", "y", "__j"])
    return pairs.select("fld", F.least("__x", "__y").alias("a"), F.greatest("__x", "__y").alias("b")).where("a < b").distinct()
