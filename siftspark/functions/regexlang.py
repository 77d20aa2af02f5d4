"""One regular expression language for all engines: linear-time (RE2) syntax, run by Spark as the Java equivalent.

In RE2 the classes ``\\w \\d \\s`` and the boundary ``\\b`` know ASCII only, case folding is
Unicode's simple one, and a dot stops at line feeds only. :func:`java` spells that out for Java.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_W, _D, _S = "0-9A-Za-z_", "0-9", r"\t\n\f\r "
# Flags are off inside: under case folding, the classes would take in two letters beyond ASCII.
_BOUNDARY = f"(?-iu:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"
_NOT_BOUNDARY = f"(?-iu:(?<=[{_W}])(?=[{_W}])|(?<![{_W}])(?![{_W}]))"


_WORD_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _starts_with_word(pattern: str, i: int) -> bool:
    """Whether whatever matches from ``i`` on surely begins with an ASCII word character: a plain one, or a group whose alternatives all do."""
    if pattern[i : i + 3] != "(?:":
        return i < len(pattern) and pattern[i] in _WORD_CHARACTERS and pattern[i + 1 : i + 2] not in ("?", "*", "{")
    depth, starts, j = 1, [i + 3], i + 3
    while j < len(pattern) and depth:
        c = pattern[j]
        if c == "\\":
            j += 1
        elif c == "[":
            j = pattern.index("]", j + 2)
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 1:
            starts.append(j + 1)
        j += 1
    return pattern[j : j + 1] not in ("?", "*", "{") and all(_starts_with_word(pattern, k) for k in starts)


def java(pattern: str, flags: str = "ium") -> str:
    """The Java spelling of an RE2 pattern. ``flags`` are RE2's i, m and s; u and d are always added."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            classes = {"w": _W, "d": _D, "s": _S}
            if n in classes:
                out.append(classes[n] if in_class else f"[{classes[n]}]")
            elif n.lower() in classes and n.isupper():
                out.append(f"&&[^{classes[n.lower()]}]" if in_class else f"[^{classes[n.lower()]}]")
            elif n == "b" and not in_class:
                # Half a boundary is enough beside a known word character (seen again, as case folding joins two letters beyond ASCII to s and k).
                if _starts_with_word(pattern, i + 2):
                    out.append(f"(?-iu:(?<![{_W}])(?=[{_W}]))")
                elif i and pattern[i - 1] in _WORD_CHARACTERS and pattern[i - 2 : i - 1] != "\\":
                    out.append(f"(?-iu:(?<=[{_W}])(?![{_W}]))")
                else:
                    out.append(_BOUNDARY)
            elif n == "B" and not in_class:
                out.append(_NOT_BOUNDARY)
            elif n == "x" and pattern[i + 2 : i + 3] == "{":
                end = pattern.index("}", i)
                out.append(pattern[i : end + 1])
                i = end + 1
                continue
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[":
            if in_class:
                out.append("\\[")
                i += 1
                continue
            in_class = True
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        if c == "]" and in_class:
            in_class = False
        elif c == "&" and in_class:
            out.append("\\&")
            i += 1
            continue
        elif c == "$" and not in_class and "m" not in flags:
            out.append("\\z")
            i += 1
            continue
        out.append(c)
        i += 1
    return f"(?{''.join(sorted({*flags, 'u', 'd'}))})" + "".join(out)


@lru_cache(None)
def python(pattern: str, flags: str = "im") -> re.Pattern:
    """The same pattern for Python workers, compiled once in each."""
    edge = f"(?-i:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c, n = pattern[i], pattern[i + 1 : i + 2]
        if c == "\\":
            plain = {"w": _W, "d": _D, "s": _S}.get(n.lower())
            if plain and n.islower():
                out.append(plain if in_class else f"[{plain}]")
            elif plain and not in_class:
                out.append(f"[^{plain}]")
            elif n == "b" and not in_class:
                out.append(edge)
            elif n == "x" and pattern[i + 2 : i + 3] == "{":
                end = pattern.index("}", i)
                out.append(f"\\U{int(pattern[i + 3 : end], 16):08x}")
                i = end + 1
                continue
            elif plain or n in "BpP":
                raise ValueError(f"not in the common dialect: \\{n} in {pattern}")
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[":
            out.append("\\[" if in_class else c)
            if not in_class and n in ("^", "]"):
                out.append(n if n == "^" else "\\]")
                i += 1
                if n == "^" and pattern[i + 1 : i + 2] == "]":
                    out.append("\\]")
                    i += 1
            in_class = True
        elif c == "]" and in_class:
            in_class = False
            out.append(c)
        elif c == "$" and not in_class and "m" not in flags:
            out.append("\\Z")
        elif in_class and c in "&~|-" and n == c:
            out.append("\\" + c)  # no set operations
        else:
            out.append(c)
        i += 1
    return re.compile("".join(out), sum({"i": re.I, "m": re.M, "s": re.S}[f] for f in flags))


def re2(pattern: str, flags: str = "im") -> str:
    """The pattern with its flags in front, as RE2 (and DuckDB) reads it."""
    return f"(?{flags})" + pattern if flags else pattern


def matches(text: Column, pattern: str, flags: str = "im") -> Column:
    return F.rlike(text, F.lit(java(pattern, flags)))


def count(text: Column, pattern: str, flags: str = "im") -> Column:
    return F.regexp_count(text, F.lit(java(pattern, flags)))


def extract_all(text: Column, pattern: str, group: int = 0, flags: str = "im") -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern, flags)), F.lit(group))


def spans(text: Column, pattern: str, flags: str = "im", only: Column | None = None) -> Column:
    """All matches of a pattern that never matches nothing: array of (start, end, match), offsets in UTF-8 bytes.

    The matches and the pieces between them alternate, so offsets are running sums of their lengths.
    """
    found = extract_all(text, pattern, 0, flags)
    # The pieces between matches, found by splitting; a limit of -1 keeps trailing empty ones.
    between = F.split(text, java(pattern, flags), -1)
    folded = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b")),
        F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc.at + F.octet_length(x.b) + F.octet_length(x.m)).alias("at"),
            F.array_append(
                acc.out,
                F.struct((acc.at + F.octet_length(x.b)).alias("start"), (acc.at + F.octet_length(x.b) + F.octet_length(x.m)).alias("end"), x.m.alias("match")),
            ).alias("out"),
        ),
        lambda acc: acc.out,
    )
    # Most texts match nothing and are done after one look.
    hit = matches(text, pattern, flags)
    return F.when(hit if only is None else only & hit, folded).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def sql_text(text: str) -> str:
    """``text`` as an SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
