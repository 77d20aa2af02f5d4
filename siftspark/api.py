"""The library's front: a scanner over DataFrames, and its small companions."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.operators import redact, sanitize, scan
from siftspark.operators.policy import BALANCED, STRICT, Profile, decide, judged
from siftspark.operators.rules import LEVELS, RULES, Rule
from siftspark.operators.text import path_kind
from siftspark.plugins import batch


def parse_level(name: str) -> int:
    """The level of a name, in any case; unknown names are an error."""
    for level, known in LEVELS.items():
        if known == name.strip().lower():
            return level
    raise ValueError(f"no level: {name}")


def profile_named(name: str | None) -> Profile:
    """strict (also for none given) or balanced; others are an error."""
    if not name or name == STRICT.name:
        return STRICT
    if name == BALANCED.name:
        return BALANCED
    raise ValueError(f"no profile: {name}")


def kind_for_path(path: Column) -> Column:
    return path_kind(path)


@dataclass(frozen=True)
class Scanner:
    """Scans documents: DataFrames with source, kind, raw, trusted and a key, or single texts.

    Every detector of ``detectors`` runs on every layer unless it says ``top_layer_only``; without ``classifier`` the lexical score is used.
    """

    profile: Profile = STRICT
    rules: Sequence[Rule] = tuple(RULES)
    detectors: Sequence = ()
    classifier: object | None = None
    options: redact.Options = field(default_factory=redact.Options)

    def _how(self) -> dict:
        classifier = scan.lexical_scores if self.classifier is None else batch(self.classifier)
        return {"rules": self.rules, "classifier": classifier, "options": self.options, "detectors": tuple((d, bool(getattr(d, "top_layer_only", False))) for d in self.detectors)}

    def scan(self, raw: str | None, kind: str = "file", source: str | None = None, trusted: bool = False) -> dict:
        """The verdict over one text: source, kind, level, action, findings, suppressed."""
        return {"source": source, "kind": kind, **decide(scan.scan_text(raw, kind, source, **self._how()), trusted, self.profile)}

    def scan_documents(self, documents: DataFrame, key: str = "doc_id", text: str = "raw") -> DataFrame:
        """key, source, kind, level, action, findings, suppressed of each document; nothing is shuffled. Tool descriptions are judged by the lexical score."""
        how = self._how()
        described = F.col("kind") == "tool_description"
        found = scan.scanned(documents, key, text, **how) if self.classifier is None else scan.scanned(documents.where(~F.coalesce(described, F.lit(False))), key, text, **how).unionByName(scan.scanned(documents.where(described), key, text, **{**how, "classifier": scan.lexical_scores}))
        return found.select(key, "source", "kind", judged(F.col("findings"), F.col("trusted"), self.profile).alias("v")).select(key, "source", "kind", "v.*")

    def sanitize(self, raw: str, kind: str = "file", source: str | None = None, trusted: bool = False) -> str:
        """What may be shown of a text."""
        from siftspark.operators.normalize import normalized

        verdict = self.scan(raw, kind, source, trusted)
        return sanitize.apply((normalized(raw) or "") if verdict["action"] == "sanitize" else raw, source, verdict)


def load_config(path: str | None) -> Scanner:
    """A scanner by a JSON file: {"policy", "redact": {"keywords", "allowlist", "minEntropy"}}, all of them optional. No file gives the defaults; unknown fields are passed over.

    The path is the caller's: nothing is read from the folder that is scanned.
    """
    if not path or not os.path.exists(path):
        return Scanner()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    hidden = given.get("redact") or {}
    options = redact.Options(keywords=tuple(hidden.get("keywords") or ()), allowlist=tuple(hidden.get("allowlist") or ()), least_entropy=float(hidden.get("minEntropy") or 0))
    return Scanner(profile=profile_named(given.get("policy")), options=options)
