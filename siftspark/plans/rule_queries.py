"""Queries of rules and policy over the corpus, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.regexlang import re2, sql_text
from siftspark.operators.policy import ACTIONS, BALANCED, STRICT, SUPPRESSED_FROM, Profile, judged
from siftspark.operators.rules import IMPACT, LEVELS, RULES, findings_column, impact, level_name, rule_findings, rule_hits, undominated_column
from siftspark.session import spread, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "kind", "trusted", "source")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_hits(_docs(spark, sf_dir), "doc_id", "text")


_HITS_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{r.rule_id}' AS rule_id, '{r.rule_set}' AS rule_set, '{r.category}' AS category, {r.confidence}::DOUBLE AS confidence, "
    f"len(regexp_extract_all(text, {sql_text(re2(r.pattern))})) AS hits FROM documents WHERE text IS NOT NULL"
    for r in RULES
)
_HITS_CTE = f"WITH all_hits AS ({_HITS_SQL}), hits AS (SELECT * FROM all_hits WHERE hits > 0)"


def rule_hits_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("rule_id", "rule_set").agg(F.count(F.lit(1)).alias("docs"), F.sum("hits").alias("hits"))


def rule_hits_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("category").agg(F.countDistinct("doc_id").alias("docs"), F.sum("hits").alias("hits"))


def rule_hits_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("doc_id", "rule_id", "hits")


def findings(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ("kind", "trusted", "source")) -> DataFrame:
    return rule_findings(_docs(spark, sf_dir), "doc_id", "text", keep)


def rule_findings_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("doc_id", "rule_id", "level", "confidence", "start", "end", "line", "excerpt")


def _findings_sql(rules=RULES) -> str:
    one = """
SELECT d.doc_id, d.kind, d.trusted, d.source, d.text, '{rule_id}' AS rule_id, '{rule_set}' AS rule_set, '{category}' AS category, {confidence}::DOUBLE AS conf,
  string_split_regex(d.text, {pattern}) AS g, regexp_extract_all(d.text, {pattern}) AS m
FROM documents d WHERE regexp_matches(d.text, {pattern})"""
    scans = " UNION ALL ".join(one.format(rule_id=r.rule_id, rule_set=r.rule_set, category=r.category, confidence=r.confidence, pattern=sql_text(re2(r.pattern))) for r in rules)
    levels = " ".join(f"WHEN '{c}' THEN {n}" for c, n in IMPACT.items())
    return f"""
scans AS ({scans}),
numbered AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM scans),
placed AS (SELECT *, list_aggregate([strlen(x) for x in g[1:i]], 'sum') + coalesce(list_aggregate([strlen(x) for x in m[1:i - 1]], 'sum'), 0) AS s,
  left(text, CAST(list_aggregate([length(x) for x in g[1:i]], 'sum') + coalesce(list_aggregate([length(x) for x in m[1:i - 1]], 'sum'), 0) AS INT)) AS before FROM numbered),
found AS (SELECT doc_id, kind, trusted, source, rule_id, category, CASE category {levels} ELSE 0 END AS level,
  round(CASE WHEN kind = 'instructions' AND category = 'system_prompt' THEN conf * 0.8
    WHEN kind = 'file' AND rule_set = 'command' AND ((length(before) - length(replace(before, '```', ''))) // 3 % 2 = 1
      OR length(string_split(before, chr(10))[-1]) - length(replace(string_split(before, chr(10))[-1], '`', '')) IN (1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 21)) THEN conf * 0.5 ELSE conf END, 6) AS confidence,
  CAST(s AS INT) AS "start", CAST(s + strlen(m[i]) AS INT) AS "end", length(before) - length(replace(before, chr(10), '')) + 1 AS line,
  replace(left(m[i], 120), chr(10), '\\n') AS excerpt FROM placed)"""


_FOUND_CTE = "WITH " + _findings_sql()


def _judged(spark: SparkSession, sf_dir: str, profile: Profile) -> DataFrame:
    """doc_id, level, action, findings, suppressed of each document, by the rules over its text as it is: one scan, nothing shuffled."""
    docs = spread(_docs(spark, sf_dir).select("doc_id", "text", "kind", "trusted"))
    found = docs.select("doc_id", "trusted", findings_column(F.col("text"), F.col("kind")).alias("f"))
    verdict = found.select("doc_id", judged(F.col("f"), F.col("trusted"), profile).alias("v"))
    return verdict.select("doc_id", "v.level", "v.action", F.size("v.findings").cast("long").alias("findings"), F.size("v.suppressed").cast("long").alias("suppressed"))


def _policy(profile: Profile):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        every = spark.createDataFrame([(n, name, ACTIONS[n]) for n, name in LEVELS.items()], "level int, level_name string, action string")
        counted = _judged(spark, sf_dir, profile).groupBy(F.col("level").alias("l")).agg(F.count(F.lit(1)).alias("documents"), F.sum("findings").alias("findings"), F.sum("suppressed").alias("suppressed"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        return every.join(counted, every.level == counted.l, "left").select("level_name", "action", zero("documents"), zero("findings"), zero("suppressed"))

    return run


def _effective_sql(p: Profile) -> str:
    level = f"level - (confidence < {p.sure} AND level > 1)::INT"
    if p.trust_lowers:
        level = f"({level}) - (coalesce(trusted, false) AND ({level}) > 1)::INT"
    return f"CASE WHEN confidence >= {p.least} THEN {level} END"


def _policy_sql(p: Profile) -> str:
    return f"""{_FOUND_CTE},
judged AS (SELECT doc_id, confidence, {_effective_sql(p)} AS e FROM found),
by_doc AS (SELECT d.doc_id, coalesce(max(e), 0) AS level, count(e) AS findings, count(*) FILTER (e IS NULL AND confidence >= {SUPPRESSED_FROM}) AS suppressed
  FROM documents d LEFT JOIN judged j USING (doc_id) GROUP BY d.doc_id),
every(level, level_name, action) AS (VALUES {", ".join(f"({n}, '{name}', '{ACTIONS[n]}')" for n, name in LEVELS.items())})
SELECT level_name, action, count(b.doc_id) AS documents, CAST(coalesce(sum(findings), 0) AS BIGINT) AS findings, CAST(coalesce(sum(suppressed), 0) AS BIGINT) AS suppressed
FROM every LEFT JOIN by_doc b USING (level) GROUP BY ALL"""


policy_strict_actions = _policy(STRICT)
policy_balanced_actions = _policy(BALANCED)


def policy_document_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, BALANCED).where("level > 0")


def suppressed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir).where((F.col("confidence") < BALANCED.least) & (F.col("confidence") >= SUPPRESSED_FROM))
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("signals"), F.countDistinct("doc_id").alias("docs"))


def fence_discounted_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {r.rule_id: r.confidence for r in RULES if r.rule_set == "command"}
    rated = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    found = findings(spark, sf_dir).where(F.col("rule_id").isin(list(known)))
    return found.groupBy("rule_id").agg(F.count_if(F.col("confidence") < rated[F.col("rule_id")]).alias("discounted"), F.count(F.lit(1)).alias("all_hits"))


def span_dedupe_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that no other of their document and category dominates: overlaps it with more confidence, or as much and an earlier place. An anti-join within each document's array of findings: one scan, nothing shuffled."""
    docs = spread(_docs(spark, sf_dir).select("doc_id", "text", "kind"))
    kept = docs.select("doc_id", findings_column(F.col("text"), F.col("kind")).alias("f")).select("doc_id", F.explode_outer(undominated_column(F.col("f"))).alias("f")).where("f IS NOT NULL")
    return kept.select("doc_id", "f.category", "f.rule_id", "f.confidence", "f.start", "f.end")


def category_impact_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "finding").dropDuplicates(["finding_id"])
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).select("category", impact(F.col("category")).alias("impact"), level_name(impact(F.col("category"))).alias("level_name"), "n")


def weak_signal_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: weak signals over many documents, or many in one, become one medium finding of the source."""
    weak = rule_hits(_docs(spark, sf_dir).select("doc_id", "text", "source"), "doc_id", "text", [r for r in RULES if r.rule_set == "weak"])
    by_doc = weak.groupBy("doc_id").agg(F.sum("hits").alias("hits"))
    by = by_doc.join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("hits").alias("total"))
    wide = ((F.col("files") >= 3) & (F.col("total") >= 4)) | ((F.col("files") == 1) & (F.col("total") >= 5))
    return by.where(wide).withColumn("confidence", F.round(F.least(0.5 + F.col("total") / 20, F.lit(0.85)), 6))


QUERIES = {
    "rule_hits_by_rule": rule_hits_by_rule,
    "rule_hits_by_category": rule_hits_by_category,
    "rule_hits_by_document": rule_hits_by_document,
    "rule_findings_spans": rule_findings_spans,
    "policy_strict_actions": policy_strict_actions,
    "policy_balanced_actions": policy_balanced_actions,
    "policy_document_levels": policy_document_levels,
    "suppressed_signals": suppressed_signals,
    "fence_discounted_commands": fence_discounted_commands,
    "span_dedupe_antijoin": span_dedupe_antijoin,
    "category_impact_join": category_impact_join,
    "weak_signal_spread": weak_signal_spread,
}

_LEVEL_CASE = " ".join(f"WHEN '{c}' THEN {n}" for c, n in IMPACT.items())
_WEAK = "'R16','R17','R18','R19','R20','R21','R22','R23'"
ORACLE = {
    "rule_hits_by_rule": f"{_HITS_CTE} SELECT rule_id, rule_set, count(*) AS docs, CAST(sum(hits) AS BIGINT) AS hits FROM hits GROUP BY ALL",
    "rule_hits_by_category": f"{_HITS_CTE} SELECT category, count(DISTINCT doc_id) AS docs, CAST(sum(hits) AS BIGINT) AS hits FROM hits GROUP BY ALL",
    "rule_hits_by_document": f"{_HITS_CTE} SELECT doc_id, rule_id, hits FROM hits",
    "rule_findings_spans": f'{_FOUND_CTE} SELECT doc_id, rule_id, level, confidence, "start", "end", line, excerpt FROM found',
    "policy_strict_actions": _policy_sql(STRICT),
    "policy_balanced_actions": _policy_sql(BALANCED),
    "policy_document_levels": f"""{_FOUND_CTE}, judged AS (SELECT doc_id, confidence, {_effective_sql(BALANCED)} AS e FROM found)
SELECT doc_id, max(e) AS level, CASE max(e) WHEN 1 THEN 'warn' WHEN 2 THEN 'sanitize' ELSE 'block' END AS action, count(e) AS findings,
  count(*) FILTER (e IS NULL AND confidence >= {SUPPRESSED_FROM}) AS suppressed FROM judged GROUP BY doc_id HAVING max(e) > 0""",
    "suppressed_signals": f"{_FOUND_CTE} SELECT rule_id, count(*) AS signals, count(DISTINCT doc_id) AS docs FROM found WHERE confidence < {BALANCED.least} AND confidence >= {SUPPRESSED_FROM} GROUP BY 1",
    "fence_discounted_commands": f"""{_FOUND_CTE}, known(rule_id, conf) AS (VALUES {", ".join(f"('{r.rule_id}', {r.confidence})" for r in RULES if r.rule_set == "command")})
SELECT rule_id, count(*) FILTER (confidence < conf) AS discounted, count(*) AS all_hits FROM found JOIN known USING (rule_id) GROUP BY 1""",
    "span_dedupe_antijoin": f"""{_FOUND_CTE} SELECT doc_id, category, rule_id, confidence, "start", "end" FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g
WHERE g.doc_id = f.doc_id AND g.category = f.category AND g."start" < f."end" AND f."start" < g."end"
  AND (g.confidence > f.confidence OR g.confidence = f.confidence AND (g.rule_id < f.rule_id OR g.rule_id = f.rule_id AND g."start" < f."start")))""",
    "category_impact_join": f"""SELECT category, CASE category {_LEVEL_CASE} ELSE 0 END AS impact,
  CASE CASE category {_LEVEL_CASE} ELSE 0 END WHEN 0 THEN 'none' WHEN 1 THEN 'base' WHEN 2 THEN 'medium' ELSE 'critical' END AS level_name, count(DISTINCT finding_id) AS n
FROM finding GROUP BY category""",
    "weak_signal_spread": f"""{_HITS_CTE}, by_doc AS (SELECT doc_id, sum(hits) AS hits FROM hits WHERE rule_id IN ({_WEAK}) GROUP BY 1),
by_source AS (SELECT source, count(*) AS files, CAST(sum(hits) AS BIGINT) AS total FROM by_doc JOIN documents USING (doc_id) GROUP BY source)
SELECT *, round(least(0.5 + total / 20, 0.85), 6) AS confidence FROM by_source WHERE files >= 3 AND total >= 4 OR files = 1 AND total >= 5""",
}
