"""The whole scan: normalise, run the detectors on the text and on every layer decoded from it, drop what is dominated; policy judges the rest.

All of it is one Arrow function from a text to an array of its findings, and policy is expressions over that array: a
document is read once, nothing is shuffled, and a verdict is a column beside its document.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.operators import redact
from siftspark.operators import text as T
from siftspark.operators.detectors import Found, detected
from siftspark.operators.layers import LAYER_BYTES, Layer, unwrapped
from siftspark.operators.rules import IMPACT, RULES, Place, Rule, confidence_at, excerpt, folded, in_bytes, matches
from siftspark.session import spread

#: A paragraph of this lexical score is an order to a model.
CLASSIFIED_FROM = 0.8
#: The order of detectors: of two equal findings the earlier one's stays.
DETECTORS = ("instruction", "weak", "command", "shell", "abort_bait", "obfuscation", "hidden", "encoded", "agent_config", "classifier", "redaction")
_ORDER = {name: i * 1000 for i, name in enumerate(DETECTORS)}
_LATE = len(DETECTORS) * 1000

#: A detector of one's own: the findings of a layer, given the raw text, kind and source of its document.
Detector = Callable[[Layer, str, str | None, str | None], Iterator[Found]]
#: Scores of texts between 0 and 1, all of a document at once.
Classifier = Callable[[Sequence[str]], Sequence[float]]

FINDINGS = (
    "array<struct<detector:string,rule_id:string,category:string,level:int,confidence:double,depth:int,chain:array<string>,"
    "start:int,end:int,root_start:int,root_end:int,space:string,line:int,excerpt:string>>"
)
_ARROW = pa.list_(
    pa.struct(
        [("detector", pa.string()), ("rule_id", pa.string()), ("category", pa.string()), ("level", pa.int32()), ("confidence", pa.float64()), ("depth", pa.int32()), ("chain", pa.list_(pa.string()))]
        + [(n, pa.int32()) for n in ("start", "end", "root_start", "root_end")]
        + [("space", pa.string()), ("line", pa.int32()), ("excerpt", pa.string())]
    )
)
NAMES = ("detector", "rule_id", "category", "level", "confidence", "depth", "chain", "start", "end", "root_start", "root_end", "space", "line", "excerpt")


def lexical_scores(texts: Sequence[str]) -> list[float]:
    """The lexical scores; 0 where a text has too few signs to reach what counts, whatever its exact score."""
    return [(T.lexical(t) or 0.0) if T.may_score(t, CLASSIFIED_FROM) else 0.0 for t in texts]


def never(texts: Sequence[str]) -> list[float]:
    """The classifier that finds nothing."""
    return [0.0] * len(texts)


def gated(cheap: Classifier, dear: Classifier, least: float = 0.2) -> Classifier:
    """A classifier that asks ``dear`` only about texts to which ``cheap`` gives ``least`` or more, all of them in one batch."""

    def scores(texts: Sequence[str]) -> list[float]:
        out = list(cheap(texts))
        asked = [i for i, s in enumerate(out) if s >= least]
        if asked:
            for i, s in zip(asked, dear([texts[i] for i in asked]), strict=True):
                out[i] = s
        return out

    return scores


def _in_rules(text: str, kind: str | None, rules: Sequence[Rule]) -> Iterator[tuple]:
    """(ordinal, detector, rule id, category, level, confidence, start, end) of the rules' matches."""
    number = {r.rule_id: i for i, r in enumerate(rules)}
    place = Place(text)
    for start, rule, end in sorted(((s, r, e) for r, s, e in matches(text, folded(text), rules)), key=lambda h: (h[0], number[h[1].rule_id])):
        place.go(start)
        yield (_ORDER.get(rule.rule_set, _LATE) + number[rule.rule_id], rule.rule_set, rule.rule_id, rule.category, IMPACT.get(rule.category, 0), confidence_at(rule, kind, place), start, end)


def _private(text: str, options: redact.Options) -> Iterator[Found]:
    """Secrets and personal data as findings; where they can't be looked for, that is a finding of its own."""
    try:
        for m in redact.found(text, options):
            category = "secret_material" if m.kind in ("secret", "auth") else "pii"
            yield ("redaction", category, IMPACT[category], m.confidence, m.start, m.end, "text")
    except Exception:  # noqa: BLE001 - a recogniser of any kind may fail in any way
        yield ("redaction", "pii", IMPACT["pii"], 1.0, 0, len(text), "text")


def _paragraphs(text: str, classifier: Classifier) -> Iterator[Found]:
    parts, at = [], 0
    for part in text.split("\n\n"):
        if part.strip():
            parts.append((at, part))
        at += len(part) + 2
    for (start, part), score in zip(parts, classifier([p for _, p in parts]), strict=True):
        if score >= CLASSIFIED_FROM:
            yield ("classifier", "instruction_override", IMPACT["instruction_override"], score, start, start + len(part), "text")


def undominated(confidence: list[float], order: list[int], start: list[int], end: list[int]) -> list[bool]:
    """Whether each finding overlaps none that is stronger, or as strong and earlier; dropped ones count as well.

    From the strongest down, the spans seen are kept as a union of intervals.
    """
    keep = [True] * len(start)
    starts: list[int] = []
    ends: list[int] = []
    for i in sorted(range(len(start)), key=lambda i: (-confidence[i], order[i], start[i])):
        a, b = start[i], end[i]
        if a >= b:
            continue
        first, last = bisect_right(ends, a), bisect_left(starts, b)
        keep[i] = first >= last
        first, last = bisect_left(ends, a), bisect_right(starts, b)
        if first < last:
            a, b = min(a, starts[first]), max(b, ends[last - 1])
        starts[first:last], ends[first:last] = [a], [b]
    return keep


def scan_text(
    raw: str | None,
    kind: str | None = None,
    source: str | None = None,
    rules: Sequence[Rule] = RULES,
    classifier: Classifier = lexical_scores,
    options: redact.Options = redact.DEFAULT,
    detectors: Sequence[tuple[Detector, bool]] = (),
) -> list[dict]:
    """The findings of a text by all detectors on all layers, without the dominated ones. ``detectors`` are further ones, each with whether it runs on the top layer only.

    Spans are UTF-8 bytes of the normalised text, of the raw one where ``space`` is raw; under a layer they are the blob's in the
    layer above, root ones in the document. Null and empty texts have none.
    """
    out: list[dict] = []
    groups: dict[tuple, list[int]] = {}
    order: list[int] = []
    above: dict[int, dict[int, int]] = {}
    for x in unwrapped(raw):
        top = x.depth == 0
        text = x.text
        found = list(_in_rules(text, kind, rules))
        others = [*detected(x, raw, kind, source), *(_paragraphs(text, classifier) if top else ()), *_private(text, options)]
        if not top and len(text) > LAYER_BYTES:
            others.append(("encoded", "encoded_payload", IMPACT["encoded_payload"], 0.45, 0, len(text), "text"))  # not decoded further
        for detector, top_only in detectors:
            if top or not top_only:
                others += detector(x, raw, kind, source)
        rows = [(*f, "text") for f in found] + [(_ORDER.get(f[0], _LATE), f[0], None, *f[1:]) for f in others]
        spots = in_bytes(text, {o for r in rows if r[8] == "text" for o in r[6:8]} | {o for c in x.inside for o in c[1:3]})
        in_raw = in_bytes(raw, {o for r in rows if r[8] == "raw" for o in r[6:8]}) if top else {}
        above[x.depth] = spots
        lines = _lines(text, {r[6] for r in rows if r[8] == "text"}) if top else {}
        for ordinal, detector, rule_id, category, level, confidence, start, end, space in rows:
            if space == "raw":
                a, b, line = in_raw[start], in_raw[end], 1 + raw.count("\n", 0, start)
                shown = "(invisible characters)" if detector == "hidden" else excerpt(raw, start, end)
            else:
                a, b, line, shown = spots[start], spots[end], lines.get(start), excerpt(text, start, end)
            root = (a, b)
            if not top:
                a, b = above[x.depth - 1][x.start], above[x.depth - 1][x.end]
                root = (above[0][x.root_start], above[0][x.root_end])
            groups.setdefault((category, x.chain, space), []).append(len(out))
            order.append(ordinal)
            values = (detector, rule_id, category, level, round(confidence, 6), x.depth, list(x.chain), a, b, *root, space, line, shown.encode("utf-8", "replace").decode())
            out.append(dict(zip(NAMES, values, strict=True)))
    kept = set()
    for members in groups.values():
        keep = undominated([out[i]["confidence"] for i in members], [order[i] for i in members], [out[i]["start"] for i in members], [out[i]["end"] for i in members])
        kept.update(i for i, k in zip(members, keep, strict=True) if k)
    return [out[i] for i in sorted(kept, key=lambda i: (out[i]["depth"], order[i], out[i]["start"]))]


def _lines(text: str, starts: set[int]) -> dict[int, int]:
    out, line, seen = {}, 1, 0
    for at in sorted(starts):
        line += text.count("\n", seen, at)
        seen, out[at] = at, line
    return out


def findings_of(text: Column, kind: Column, source: Column, **how) -> Column:
    """All findings of each text as one array; ``how`` as of :func:`scan_text`."""

    @F.arrow_udf(FINDINGS)
    def run(texts: pa.Array, kinds: pa.Array, sources: pa.Array) -> pa.Array:
        return pa.array([scan_text(*row, **how) for row in zip(texts.to_pylist(), kinds.to_pylist(), sources.to_pylist(), strict=True)], _ARROW)

    # Called nondeterministic, as Spark would else scan once more for each filter on what is found.
    return run.asNondeterministic()(text, kind, source)


def scanned(docs: DataFrame, key: str, text: str, **how) -> DataFrame:
    """key, source, kind, trusted, findings of each document (key, text, kind, trusted, source); null and empty texts have none."""
    return spread(docs.select(key, "source", "kind", "trusted", text)).select(key, "source", "kind", "trusted", findings_of(F.col(text), F.col("kind"), F.col("source"), **how).alias("findings"))


def scan_findings(docs: DataFrame, key: str, text: str, **how) -> DataFrame:
    """One row for each finding: key, kind, trusted, source, and the fields of :data:`NAMES`."""
    # Outer, as Spark would else scan once more to filter out documents without findings.
    return scanned(docs, key, text, **how).select(key, "kind", "trusted", "source", F.explode_outer("findings").alias("__f")).where(F.col("__f").isNotNull()).select(key, "kind", "trusted", "source", "__f.*")
