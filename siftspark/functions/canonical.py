"""Canonical spellings of JSON text."""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: str) -> str:
    try:
        value = Decimal(text)
    except InvalidOperation:
        return text
    if not value:
        return "0"
    sign, digits, exponent = value.as_tuple()
    kept = "".join(map(str, digits)).lstrip("0")
    bare = kept.rstrip("0")
    return f"{'-' if sign else ''}{bare}e{exponent + len(kept) - len(bare)}"


def _write(value, out: list[str]) -> None:
    if value is None:
        out.append("null")
    elif value is True:
        out.append("true")
    elif value is False:
        out.append("false")
    elif isinstance(value, str):
        out.append(json.dumps(value))
    elif isinstance(value, _Number):
        out.append(value.text)
    elif isinstance(value, list):
        out.append("[")
        for i, item in enumerate(value):
            if i:
                out.append(",")
            _write(item, out)
        out.append("]")
    else:
        out.append("{")
        for i, key in enumerate(sorted(value)):
            if i:
                out.append(",")
            out.append(json.dumps(key))
            out.append(":")
            _write(value[key], out)
        out.append("}")


class _Number:
    __slots__ = ("text",)

    def __init__(self, text: str) -> None:
        self.text = _number(text)


def canonical_json_text(text: str | None) -> str | None:
    """One spelling for each JSON value: sorted keys, no blanks, ASCII escapes, numbers by value.

    Null stays null. Text that isn't JSON (or is nested too deeply) comes back
    behind a ``!`` so that it equals only the same text. Of a repeated key the last counts.
    """
    if text is None:
        return None
    try:
        value = json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=lambda c: {"\0constant": c})
        out: list[str] = []
        _write(value, out)
        return "".join(out)
    except (ValueError, RecursionError):
        return "!" + text


def canonical_json(column: Column) -> Column:
    """Column of :func:`canonical_json_text`; each distinct text of a batch is parsed once."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, str | None] = {}
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            if text not in known:
                known[text] = canonical_json_text(text)
            out.append(known[text])
        return pd.Series(out, dtype=object)

    return run(column)
