"""Contextual analysis of a request's documents against its task: checked, packed into windows a model can take, scored, and summed up.

Advisory: its results never change a verdict. The model is a backend given by the caller. A result over part of a request has no score.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The contract, what documents may be, tokens of a window, bytes of the first cut, characters of overlap.
CONTRACT, KINDS, TRUST = "context-json-v2", ("file", "web", "mcp"), ("untrusted", "user-provided")
WINDOW_TOKENS, FIRST_CUT, OVERLAP = 512, 2048, 32


@dataclass(frozen=True)
class Limits:
    """Fixed values unless given: bytes and documents of a request, windows of its plan. A request over one is an error, never cut."""

    most_bytes: int = 1 << 20
    most_documents: int = 128
    most_windows: int = 32


class Backend(Protocol):
    """A model: its tokens of a serialised request, and its score of it between 0 and 1. It must not cut what it is given."""

    threshold: float

    def tokens(self, text: str) -> int: ...

    def score(self, text: str) -> float: ...


class Failed(ValueError):
    """Why a request has no result."""


def serialize(contract: str, task: str, documents: Sequence[dict]) -> str:
    """The request as compact JSON in the order the model was trained on; sources aren't in it."""
    shown = [{"kind": d["kind"], "trust": d["trust"], "text": d["text"]} for d in documents]
    return json.dumps({"contract": contract, "task": task, "documents": shown}, ensure_ascii=False, separators=(",", ":")).replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


#: Bytes of a request as JSON.
REQUEST_BYTES = 8 << 20
_FIELDS, _DOCUMENT_FIELDS = {"contract", "task", "documents"}, {"kind", "trust", "text", "source"}


def read_request(text: str | None) -> tuple[str | None, str | None, list[dict]]:
    """(contract, task, documents) of a request as JSON. Refused: what isn't one object, has unknown or repeated fields, fields of another kind, anything behind it, or over the limit."""

    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) != len(items):
            raise Failed("repeated field")
        return dict(items)

    if text is None or len(text.encode("utf-8", "replace")) > REQUEST_BYTES:
        raise Failed("no request, or over the limit")
    value = json.loads(text, object_pairs_hook=pairs)
    words = lambda d, names: all(d.get(n) is None or isinstance(d[n], str) for n in names)
    if not isinstance(value, dict) or not set(value) <= _FIELDS or not words(value, ("contract", "task")) or not isinstance(value.get("documents", []), list | type(None)):
        raise Failed("form")
    documents = value.get("documents") or []
    if not all(isinstance(d, dict) and set(d) <= _DOCUMENT_FIELDS and words(d, _DOCUMENT_FIELDS) for d in documents):
        raise Failed("form of a document")
    return value.get("contract"), value.get("task"), [{n: d.get(n) for n in ("kind", "trust", "text", "source")} for d in documents]


def _boundary(raw: bytes, end: int, start: int) -> int:
    """``end`` or the last start of a character before it."""
    while start < end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return end


def plan(contract: str, task: str, documents: Sequence[dict], backend: Backend, limits: Limits = Limits()) -> list[dict]:
    """Windows of at most :data:`WINDOW_TOKENS`: {documents, ranges (document, start, end in bytes), tokens}. All documents in one if they fit, else as many in a row as fit, else one in pieces that overlap."""
    cost = lambda docs: backend.tokens(serialize(contract, task, docs))
    whole = lambda i: (i, 0, len(documents[i]["text"].encode()))
    if (n := cost(documents)) <= WINDOW_TOKENS:
        return [{"documents": list(documents), "ranges": [whole(i) for i in range(len(documents))], "tokens": n}]
    out: list[dict] = []
    open_window: dict | None = None

    def close() -> None:
        nonlocal open_window
        if open_window:
            if len(out) >= limits.most_windows:
                raise Failed("too many windows")
            out.append(open_window)
        open_window = None

    for i, document in enumerate(documents):
        grown = [*(open_window["documents"] if open_window else ()), document]
        if (n := cost(grown)) <= WINDOW_TOKENS:
            open_window = {"documents": grown, "ranges": [*(open_window["ranges"] if open_window else ()), whole(i)], "tokens": n}
            continue
        close()
        if (n := cost([document])) <= WINDOW_TOKENS:
            open_window = {"documents": [document], "ranges": [whole(i)], "tokens": n}
            continue
        raw = document["text"].encode()
        start = 0
        while start < len(raw):
            end = _boundary(raw, min(len(raw), start + FIRST_CUT), start)
            while True:
                piece = {**document, "text": raw[start:end].decode()}
                if end <= start or not piece["text"].strip():
                    raise Failed("no room for text, or nothing but blanks")
                if (n := cost([piece])) <= WINDOW_TOKENS:
                    break
                end = _boundary(raw, start + (end - start) // 2, start)
            open_window = {"documents": [piece], "ranges": [(i, start, end)], "tokens": n}
            close()
            if end == len(raw):
                break
            back = len(piece["text"][-OVERLAP:].encode())
            start = end - back if back < end - start else end
    close()
    return out


def analyze(contract: str | None, task: str | None, documents: Sequence[dict], backend: Backend, limits: Limits = Limits()) -> dict:
    """status, reason, coverage, score, attack, windows, warnings of a request.

    Without a task it is skipped (missing-context), which is no clean verdict; whatever fails gives an error and no score, with the windows scored before.
    """
    out = {"status": "error", "reason": "invalid-input", "coverage": "none", "score": None, "attack": None, "windows": [], "warnings": []}
    if contract != CONTRACT:
        return out
    if not (task or "").strip():
        return {**out, "status": "missing-context", "reason": "missing-user-task"}
    if not 0 < len(documents) <= limits.most_documents:
        return out
    size = len(task.encode("utf-8", "replace"))
    for d in documents:
        try:
            size += len((d["text"] or "").encode()) + len((d.get("source") or "").encode())
        except UnicodeEncodeError:
            return out
        if not (d["text"] or "").strip() or d["kind"] not in KINDS or d["trust"] not in TRUST:
            return out
    if size > limits.most_bytes:
        return {**out, "reason": "input-limit"}
    try:
        windows = plan(contract, task, documents, backend, limits)
    except Exception:  # noqa: BLE001 - a backend may fail in any way
        return {**out, "reason": "planning-failed"}
    done: list[dict] = []
    for w in windows:
        reason = "inference-failed"
        try:
            score = backend.score(serialize(contract, task, w["documents"]))
            reason = "invalid-score"
            if not (isinstance(score, int | float) and math.isfinite(score) and 0 <= score <= 1):
                raise Failed(reason)
        except TimeoutError:
            return {**out, "reason": "timeout-or-cancelled", "coverage": "partial" if done else "none", "windows": done}
        except Exception:  # noqa: BLE001
            return {**out, "reason": reason, "coverage": "partial" if done else "none", "windows": done}
        done.append({"ranges": w["ranges"], "tokens": w["tokens"], "score": float(score), "attack": score >= backend.threshold})
    best = max(w["score"] for w in done)
    several = len(done) > 1
    return {
        "status": "complete", "reason": "frozen-threshold", "coverage": "segmented" if several else "joint", "score": best, "attack": best >= backend.threshold, "windows": done,
        "warnings": ["What acts across windows isn't seen; the highest score of several windows isn't calibrated to whole requests."] if several else [],
    }


SCHEMA = "request_id long, status string, reason string, coverage string, score double, attack boolean, windows int, tokens int"


def analyzed(rows: DataFrame, backend: Backend, limits: Limits = Limits()) -> DataFrame:
    """One row for each request_id of ``rows`` (request_id, doc_no, contract, task, kind, trust, text, source): :data:`SCHEMA`.

    Rows sent twice count once. Requests over the limits are told by counts before any group is formed, so a group holds at most that many documents and bytes.
    """
    once = rows.select("request_id", "doc_no", "contract", "task", "kind", "trust", "text", "source").dropDuplicates(["request_id", "doc_no"])
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("source"), F.lit(0))
    sizes = once.groupBy("request_id").agg(F.count(F.lit(1)).alias("__n"), (F.sum(size) + F.max(F.coalesce(F.octet_length("task"), F.lit(0)))).alias("__size"), F.max("contract").alias("__contract"), F.max("task").alias("__task"))
    too_many, too_big = F.col("__n") > limits.most_documents, F.col("__size") > limits.most_bytes
    over = sizes.where(too_many | too_big)
    fits = once.join(sizes.where(~(too_many | too_big)).select("request_id"), "request_id", "left_semi")

    def one(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs)).sort_values("doc_no")
        value = lambda x: None if pd.isna(x) else x
        documents = [{"kind": r.kind, "trust": r.trust, "text": value(r.text), "source": value(r.source)} for r in pdf.itertuples()]
        r = analyze(value(pdf.contract.iloc[0]), value(pdf.task.iloc[0]), documents, backend, limits)
        yield pd.DataFrame([(key[0], r["status"], r["reason"], r["coverage"], r["score"], r["attack"], len(r["windows"]), sum(w["tokens"] for w in r["windows"]))], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    done = fits.groupBy("request_id").applyInPandas(lambda key, pdf: next(one(key, iter([pdf]))), SCHEMA)
    asked = (F.col("__contract") == CONTRACT) & (F.trim(F.coalesce("__task", F.lit(""))) != "")
    status = F.when((F.col("__contract") == CONTRACT) & ~asked, "missing-context").otherwise("error")
    reason = F.when((F.col("__contract") == CONTRACT) & ~asked, "missing-user-task").when(asked & ~too_many, "input-limit").otherwise("invalid-input")
    none = F.lit(None)
    rest = over.select("request_id", status.alias("status"), reason.alias("reason"), F.lit("none").alias("coverage"), none.cast("double").alias("score"), none.cast("boolean").alias("attack"), F.lit(0).alias("windows"), F.lit(0).alias("tokens"))
    return done.unionByName(rest)


class LexicalBackend:
    """A backend without a model: a token a character and two more, and the lexical score."""

    threshold = 0.8

    def tokens(self, text: str) -> int:
        return len(text) + 2

    def score(self, text: str) -> float:
        from siftspark.operators.text import lexical

        return lexical(text) or 0.0
