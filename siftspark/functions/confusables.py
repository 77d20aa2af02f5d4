"""Letters drawn like ASCII ones: a short list by script, rules by the names of characters, and, where it is given, the whole of Unicode's own file.

The list holds the scripts that are used to pose as Latin. For the full data of UTS 39, name its file ``confusables.txt`` in the
environment variable ``SIFTSPARK_CONFUSABLES`` of the workers.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

# Letters of a script, and what each is drawn like, in the same place.
_ALIKE = (
    # Cyrillic capitals and small letters
    ("АВЕЅІЈКМНОРСТУХҮӀԌԚԜѴЗЬ", "ABESIJKMHOPCTYXYIGQWV3b"),
    ("абгеіјопрсухѕһӏԁԍԛԝѵү", "a6reijonpcyxshldgqwvy"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    ("αγηικνορστυχϲϳ", "aynikvopotuxcj"),
    # Armenian
    ("ԼՍՏՕազհյոսցօ", "LUSOwqhjnugo"),
    # Cherokee
    ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ", "DRTiyAJEWMHYGZ4bRWSVSLCPKdB"),
    # Coptic
    ("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "BHIKMNOPCTYXopc"),
    # Lisu
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
)
# Names of characters that say what they are drawn like: two letters in one sign, small capitals, and letters in a hand or without their dot.
_NAMED = (
    (re.compile(r"LATIN CAPITAL LETTER ([A-Z]{2})"), str.upper),
    (re.compile(r"LATIN SMALL LETTER ([A-Z]{2})"), str.lower),
    (re.compile(r"LATIN LETTER SMALL CAPITAL ([A-Z])"), str.lower),
    (re.compile(r"LATIN SMALL LETTER (?:BLACKLETTER |DOTLESS |SCRIPT |SIDEWAYS )([A-Z])"), str.lower),
    (re.compile(r"OUTLINED LATIN CAPITAL LETTER ([A-Z])"), str.upper),
)
#: Two-letter names that are names of sounds or abbreviations, not of what is drawn.
_SOUNDS = ("DZ", "ET", "EZ", "HV", "IS", "LJ", "NJ", "OI", "SH", "UM")


def _by_name() -> dict[str, str]:
    out = {}
    for point in (*range(0x00C6, 0x0250), *range(0x0250, 0x02B0), *range(0x1D00, 0x1D80), *range(0xA722, 0xA7FF), *range(0xAB30, 0xAB6B), *range(0x1CCD6, 0x1CCF0)):
        name = unicodedata.name(chr(point), "")
        for pattern, case in _NAMED:
            m = pattern.fullmatch(name)
            if m and m[1] not in _SOUNDS:
                out[chr(point)] = case(m[1])
    return out


def read(path: str) -> dict[str, str]:
    """The entries of a file in the form of Unicode's confusables.txt that map one character to ASCII text."""
    out = {}
    with open(path, encoding="utf-8-sig") as lines:
        for line in lines:
            parts = line.split("#", 1)[0].split(";")
            if len(parts) >= 2 and parts[0].strip():
                source, target = (_text(p) for p in parts[:2])
                if len(source) == 1 and not source.isascii() and target.isascii():
                    out[source] = target
    return out


def _text(points: str) -> str:
    return "".join(chr(int(p, 16)) for p in points.split())


@lru_cache(1)
def confusables() -> dict[str, str]:
    """What each look-alike is drawn like."""
    out = _by_name()
    for letters, drawn in _ALIKE:
        out.update(zip(letters, drawn, strict=True))
    path = os.environ.get("SIFTSPARK_CONFUSABLES")
    return out | read(path) if path else out
