"""Policy: from findings to effective levels, verdicts and actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each level does.
ACTIONS = {0: "pass", 1: "warn", 2: "sanitize", 3: "block"}
#: Findings under the profile's floor but not under this are kept as suppressed signals.
SUPPRESSED_FROM = 0.2


@dataclass(frozen=True)
class Profile:
    name: str
    least: float
    sure: float
    trust_lowers: bool


STRICT = Profile("strict", 0.25, 0.55, False)
BALANCED = Profile("balanced", 0.4, 0.7, True)


def action(level: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[level]


def effective_level(level: Column, confidence: Column, trusted: Column, profile: Profile) -> Column:
    """Null for findings under the floor; else the level, one less if unsure, and one less if trusted, never under base."""
    out = F.when((confidence < profile.sure) & (level > 1), level - 1).otherwise(level)
    if profile.trust_lowers:
        out = F.when(F.coalesce(trusted, F.lit(False)) & (out > 1), out - 1).otherwise(out)
    return F.when(confidence >= profile.least, out)


def verdicts(docs: DataFrame, findings: DataFrame, key: str, profile: Profile = STRICT) -> DataFrame:
    """One row for each document: key, level, action, findings, suppressed. Documents without findings pass."""
    trusted = F.col("trusted") if "trusted" in findings.columns else F.lit(None).cast("boolean")
    judged = findings.withColumn("effective", effective_level(F.col("level"), F.col("confidence"), trusted, profile))
    by = judged.groupBy(key).agg(
        F.max("effective").alias("level"),
        F.count("effective").alias("findings"),
        F.count_if(F.col("effective").isNull() & (F.col("confidence") >= SUPPRESSED_FROM)).alias("suppressed"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = docs.join(by, key, "left").select(docs[key], zero("level"), zero("findings"), zero("suppressed"))
    return joined.withColumn("action", action(F.col("level")))


def judged(findings: Column, trusted: Column, profile: Profile = STRICT) -> Column:
    """The verdict over an array of findings: (level, action, findings, suppressed), without a shuffle.

    ``findings`` are those at or over the profile's floor with their effective levels, the highest first, then by place; ``suppressed`` the signals under it.
    """
    rated = F.transform(findings, lambda f: f.withField("level", F.coalesce(effective_level(f.level, f.confidence, trusted, profile), F.lit(-1))))
    kept = F.filter(rated, lambda f: f.level >= 0)
    ordered = F.array_sort(F.transform(kept, lambda f, i: F.struct((-f.level).alias("down"), f.start.alias("at"), i.alias("i"))))
    placed = F.transform(ordered, lambda o: F.get(kept, o.i))
    level = F.coalesce(F.array_max(F.transform(kept, lambda f: f.level)), F.lit(0))
    quiet = F.filter(findings, lambda f: (f.confidence < profile.least) & (f.confidence >= SUPPRESSED_FROM))
    return F.struct(level.alias("level"), action(level).alias("action"), placed.alias("findings"), quiet.alias("suppressed"))


def decide(findings: list[dict], trusted: bool | None = False, profile: Profile = STRICT) -> dict:
    """:func:`judged` for Python workers: level, action, findings and suppressed of one document."""
    kept = []
    for i, f in enumerate(findings):
        if f["confidence"] < profile.least:
            continue
        level = f["level"] - (f["confidence"] < profile.sure and f["level"] > 1)
        level -= bool(profile.trust_lowers and trusted and level > 1)
        kept.append((-level, f["start"], i, {**f, "level": level}))
    kept.sort(key=lambda k: k[:3])
    level = -kept[0][0] if kept else 0
    quiet = [f for f in findings if SUPPRESSED_FROM <= f["confidence"] < profile.least]
    return {"level": level, "action": ACTIONS[level], "findings": [k[3] for k in kept], "suppressed": quiet}
