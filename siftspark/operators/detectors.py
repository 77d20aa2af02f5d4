"""Detectors beside the rules: hidden and obfuscated text, abort bait, encoded payloads, agent configuration, shell.

Each gives (detector, category, level, confidence, start, end, space); offsets are characters of the
normalised text, or of the raw one where ``space`` is ``raw``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from siftspark.functions import regexlang
from siftspark.operators import text as T
from siftspark.operators.layers import Layer
from siftspark.operators.normalize import invisible, mixed_script
from siftspark.operators.rules import IMPACT
from siftspark.operators.shell import shell_spans

# Words that show a comment to be meant for a model.
_ADDRESSED = re.compile(r"instruction|ignore|assistant|agent|claude|gpt|model|system|инструкц|игнорир|ассистент|агент", re.I)
_MARKDOWN_COMMENT = re.compile(r"^\[[^\]\n]*\]:[ \t]*#[ \t]*\([^\n]*\)[ \t\r]*$", re.M)
_CSS = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|opacity\s*:\s*0|color\s*:\s*(?:white|#fff(?:fff)?|transparent))[^<>]{0,4000}>", re.I)
_ATTRIBUTE = re.compile(r"<[a-z]+\b[^<>]{0,4000}?(?:\bhidden\b|\baria-hidden=\"true\")", re.I)
_SPACED = re.compile(r"(?:[^\W_][ \t]+){5,}[^\W_]\b")
_BROKEN = re.compile(r"(?:[^\W_][._-]){4,}[^\W_]")
_FRAMING, _REVIEWER = regexlang.python(T.FRAMING), regexlang.python(T.REVIEWER)
# Topics put into a text to make a reviewer refuse: agents and arms that kill many, the making of pathogens, abuse of children; EN and RU.
_ARMS = r"(?:bio(?:logical)?[- ]?|chemical |nuclear |radiological )(?:agents?|arms|bombs?|devices?|warheads?|weapons?)|dirty bombs?|nerve (?:agents?|gas)|weapons? of mass destruction|wmd"
_MAKING = r"(?:cultur|synthesi[sz]|weaponi[sz])(?:e|ing) (?:an? |the )?(?:anthrax|nerve agents?|pathogens?|ricin|sarin|smallpox|toxins?|virus(?:es)?)"
_TOPIC = re.compile(
    rf"\b(?:{_ARMS}|{_MAKING}|bioterror(?:ism|ist)?|child (?:abuse material|sexual abuse)|csam|mass[- ]?casualt(?:ies|y)|"
    r"(?:био(?:логическ\w+ )?|химическ\w+ |ядерн\w+ )оружи[еяю]|оружи[еяю] массового поражения|синтез\w* (?:вируса|отравляющ\w+|патогена))\b",
    re.I,
)
_TOPIC_SIGNS = ("agents", "agent", "anthrax", "arms", "bomb", "casualt", "csam", "child ", "device", "gas", "patho", "ricin", "sarin", "smallpox", "terror", "toxin", "virus", "warhead", "weapon", "wmd", "оружи", "синтез")
#: Encodings that are views of ordinary text: only what is found in them counts.
VIEWS = ("rot13", "entities-context")

Found = tuple[str, str, int, float, int, int, str]


def _of(detector: str, category: str, confidence: float, start: int, end: int, space: str = "text") -> Found:
    return (detector, category, IMPACT[category], confidence, start, end, space)


def hidden(text: str, raw: str | None) -> Iterator[Found]:
    """What a reader doesn't see; invisible characters are counted in the raw text of the top layer."""
    at = [i for i, c in enumerate(raw) if invisible(c)] if raw and not raw.isascii() else []
    if len(at) >= 3:
        yield _of("hidden", "hidden_text", min(0.5 + len(at) / 40, 0.95), at[0], at[-1] + 1, "raw")
    start = text.find("<!--")
    while start >= 0 and (end := text.find("-->", start + 4)) >= 0:
        if _ADDRESSED.search(text, start + 4, end):
            yield _of("hidden", "hidden_text", 0.7, start, end + 3)
        start = text.find("<!--", end + 3)
    for m in _MARKDOWN_COMMENT.finditer(text):
        yield _of("hidden", "hidden_text", 0.5, *m.span())
    for pattern in (_CSS, _ATTRIBUTE) if "<" in text or ">" in text else ():
        for m in pattern.finditer(text):
            yield _of("hidden", "hidden_text", 0.6, *m.span())


def obfuscation(text: str, raw: str | None) -> Iterator[Found]:
    """Spaced or broken words; words of mixed scripts are counted in the raw text of the top layer."""
    for pattern, confidence in ((_SPACED, 0.8), (_BROKEN, 0.7)):
        for m in pattern.finditer(text):
            yield _of("obfuscation", "obfuscation", confidence, *m.span())
    mixed = [m.span() for m in re.finditer(r"\S{3,}", raw) if not m[0].isascii() and mixed_script(m[0])] if raw and not raw.isascii() else []
    if len(mixed) >= 3:
        yield _of("obfuscation", "obfuscation", min(0.5 + len(mixed) / 20, 0.9), mixed[0][0], mixed[-1][1], "raw")


def abort_bait(text: str, kind: str | None) -> Iterator[Found]:
    """Orders to a reviewer to stop, and topics put beside them to make one refuse."""
    low = text.lower()
    framing = [m.span() for m in _FRAMING.finditer(text)] if T.has_any(low, T.FRAMING_SIGNS) else []
    for start, end in framing:
        yield _of("abort_bait", "abort_bait", 0.9 if _REVIEWER.search(text[max(0, start - 40) : end + 40]) else 0.75, start, end)
    for m in _TOPIC.finditer(text) if T.has_any(low, _TOPIC_SIGNS) else ():
        near = _FRAMING.search(text[max(0, m.start() - 160) : m.end() + 160])
        confidence = 0.9 if near else 0.7 if framing else 0.6 if kind == "agent_config" else 0.0
        if confidence:
            yield _of("abort_bait", "abort_bait", confidence, *m.span())


def encoded(layer: Layer, kind: str | None) -> Iterator[Found]:
    for encoding, start, end, _ in layer.inside:
        if encoding not in VIEWS:
            yield _of("encoded", "encoded_payload", 0.7 if kind in ("instructions", "tool_description") else 0.45, start, end)


def agent_config(text: str, kind: str | None) -> Iterator[Found]:
    """Hooks and servers of a settings file; whole lines of comment are left out."""
    if kind != "agent_config":
        return
    try:
        root = json.loads("\n".join(x for x in text.split("\n") if not x.strip().startswith("//")))
    except (ValueError, RecursionError):
        return
    for name, category, level, confidence in (("hooks", "hook_config", IMPACT["hook_config"], 0.9), ("mcpServers", "arbitrary_command", 2, 0.6)):
        if isinstance(root, dict) and name in root and len(json.dumps(root[name])) > 2:
            start = max(text.find(f'"{name}"'), 0)
            yield ("agent_config", category, level, confidence, start, start + len(name) + 2, "text")


def detected(layer: Layer, raw: str, kind: str | None, source: str | None) -> Iterator[Found]:
    """The findings of all detectors but the rules in one layer."""
    top = layer.depth == 0
    for category, confidence, start, end in shell_spans(layer.text, kind, source):
        # Running what was downloaded is never critical by itself: medium from a doubtful place, else base.
        level = IMPACT[category] if category != "remote_exec" else 2 if confidence in (0.7, 0.35) else 1
        yield ("shell", category, level, confidence, start, end, "text")
    yield from abort_bait(layer.text, kind)
    yield from obfuscation(layer.text, raw if top else None)
    yield from hidden(layer.text, raw if top else None)
    yield from encoded(layer, kind)
    if top:
        yield from agent_config(layer.text, kind)
