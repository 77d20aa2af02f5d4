"""Where own code plugs in. Everything here is called in Python workers, so it must be picklable; a model is loaded once in each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Protocol

from siftspark.operators.context import Backend
from siftspark.operators.detectors import Found
from siftspark.operators.layers import Layer
from siftspark.operators.policy import Profile
from siftspark.operators.redact import Match

__all__ = ["OCR", "Backend", "BatchClassifier", "Blocklist", "Classifier", "Detector", "NER", "Pinner", "Policy", "Scorer", "batch"]


class Detector(Protocol):
    """Findings of a layer. ``top_layer_only``: only of the document's own text, not of what is decoded from it."""

    top_layer_only: bool

    def __call__(self, layer: Layer, raw: str, kind: str | None, source: str | None) -> Iterator[Found]: ...


class Policy(Protocol):
    """A verdict (level, action, findings, suppressed) over findings."""

    def __call__(self, findings: list[dict], trusted: bool | None, profile: Profile) -> dict: ...


class Classifier(Protocol):
    def score(self, text: str) -> float: ...


class BatchClassifier(Protocol):
    def scores(self, texts: Sequence[str]) -> Sequence[float]: ...


#: The public name of what gives a score to a text.
Scorer = Classifier


class NER(Protocol):
    """Names, places and the like in a text. What it raises makes the text unfit to be shown."""

    def __call__(self, text: str) -> Iterable[Match]: ...


class OCR(Protocol):
    """The text in an image, or null."""

    def __call__(self, content: bytes) -> str | None: ...


class Blocklist(Protocol):
    def blocked(self, source: str) -> bool: ...

    def block(self, source: str, reason: str) -> None: ...


class Pinner(Protocol):
    """Whether a tool was known before, and whether its hash has changed since it was first seen."""

    def seen(self, tool: str, digest: str) -> tuple[bool, bool]: ...


def batch(classifier: Classifier | BatchClassifier):
    """A classifier of either kind as the scan takes it: all of a document's texts at once."""
    if hasattr(classifier, "scores"):
        return classifier.scores
    return lambda texts: [classifier.score(t) for t in texts]


# Entity labels of recognisers and the labels they are hidden under; those of persons count unless others are asked for.
ENTITIES = {"FIRSTNAME": "full_name", "FIRST_NAME": "full_name", "GIVENNAME": "full_name", "LASTNAME": "full_name", "LAST_NAME": "full_name", "MIDDLENAME": "full_name", "MIDDLE_NAME": "full_name", "NAME": "full_name", "PER": "full_name", "PERSON": "full_name", "SURNAME": "full_name"}
#: Tokens of a recogniser's window, of the overlap of two, and the most windows of a text; beyond them the text can't be inspected.
NER_WINDOW, NER_OVERLAP, NER_WINDOWS = 512, 32, 32


def entity_spans(tokens: Sequence[tuple[int, int, str, float]]) -> list[Match]:
    """Matches of tokens (start, end, tag, probability) with tags B-X, I-X or O: tokens of one label that touch or have one character between are one span, which has their mean probability."""
    out: list[tuple[str, int, int, list[float]]] = []
    for start, end, tag, probability in sorted(tokens):
        begins, _, label = tag.partition("-")
        name = ENTITIES.get(label.upper())
        if not name or not label:
            continue
        if out and begins == "I" and out[-1][0] == name and start - out[-1][2] <= 1:
            out[-1] = (name, out[-1][1], max(end, out[-1][2]), [*out[-1][3], probability])
        else:
            out.append((name, start, end, [probability]))
    return [Match("pii", name, a, b, sum(p) / len(p)) for name, a, b, p in out]


def windows(n: int, size: int = NER_WINDOW, overlap: int = NER_OVERLAP, most: int = NER_WINDOWS) -> list[tuple[int, int]]:
    """(start, end) of windows over ``n`` tokens. More than ``most`` is an error: a text is inspected whole or not shown."""
    if n <= 0:
        return []
    out, start = [], 0
    while True:
        out.append((start, min(n, start + size)))
        if len(out) > most:
            raise ValueError("the text has too many windows to be inspected")
        if start + size >= n:
            return out
        start += size - overlap
