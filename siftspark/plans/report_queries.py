"""Queries of joins, aggregates, windows, reports and state over scan results. Each runs as Spark SQL; the oracle is DuckDB's SQL for the same rows.

Findings, hook inputs and snapshots may be sent twice; the views read here have each once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftspark.operators.policy import ACTIONS, STRICT
from siftspark.operators.rules import IMPACT
from siftspark.session import table

_KEYS = {"finding": ["finding_id"], "hook_input": ["input_id"], "context_document": ["request_id", "doc_no"]}
_LEVEL = "CASE lower(level) WHEN 'critical' THEN 3 WHEN 'medium' THEN 2 WHEN 'base' THEN 1 ELSE 0 END"
_IMPACT = "CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in IMPACT.items()) + " ELSE 0 END"
_ACTION = "CASE {} " + " ".join(f"WHEN {n} THEN '{a}'" for n, a in ACTIONS.items()) + " END"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, spark_sql: str, duck_sql: str | None = None, tables: tuple[str, ...] = ("finding",)) -> None:
    """``spark_sql`` names its tables in braces; without ``duck_sql`` the same text serves both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = {t: table(spark, sf_dir, t).dropDuplicates(_KEYS[t]) if t in _KEYS else table(spark, sf_dir, t) for t in tables}
        return spark.sql(spark_sql, **views)

    duck = duck_sql or spark_sql
    for t in tables:
        source = f"(SELECT DISTINCT ON ({', '.join(_KEYS[t])}) * FROM {t})" if t in _KEYS else t
        duck = duck.replace("{" + t + "}", source)
    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = duck


# ---- aggregates -------------------------------------------------------------------------
_add("stats_by_category", "SELECT category, count(*) AS findings, count(DISTINCT scan_id) AS documents, min(found_at) AS first_seen, max(found_at) AS last_seen FROM {finding} GROUP BY category")
_add("stats_by_level", f"SELECT {_LEVEL} AS level, count(*) AS findings FROM {{finding}} GROUP BY 1")
_add(
    "stats_grouping_sets",
    f"SELECT category, lvl, source, count(*) AS n FROM (SELECT category, {_LEVEL} AS lvl, source FROM {{finding}}) AS f GROUP BY GROUPING SETS ((category), (lvl), (source))",
)
_add("stats_rollup", f"SELECT detector, category, count(*) AS n FROM {{finding}} GROUP BY ROLLUP (detector, category)")
_add("stats_cube", f"SELECT category, lvl, count(*) AS n FROM (SELECT category, {_LEVEL} AS lvl FROM {{finding}}) AS f GROUP BY CUBE (category, lvl)")
_add(
    "summary_level",
    f"SELECT count(*) AS scanned, max(level) AS level, count(CASE WHEN level > 0 THEN 1 END) AS with_findings FROM (SELECT s.scan_id, coalesce(max({_IMPACT}), 0) AS level FROM {{scan_document}} AS s LEFT JOIN {{finding}} AS f ON s.scan_id = f.scan_id GROUP BY s.scan_id) AS v",
    tables=("finding", "scan_document"),
)
_add("exit_code", f"SELECT CASE WHEN max({_IMPACT}) >= 2 THEN max({_IMPACT}) ELSE 0 END AS exit_code FROM {{finding}}")
# Policy over findings: the strict profile's floor and doubt.
_EFFECTIVE = f"CASE WHEN coalesce(confidence, 0) >= {STRICT.least} THEN {_IMPACT} - CASE WHEN confidence < {STRICT.sure} AND {_IMPACT} > 1 THEN 1 ELSE 0 END ELSE 0 END"
_add(
    "document_actions",
    f"SELECT level, {_ACTION.format('level')} AS action, count(*) AS documents FROM (SELECT scan_id, max({_EFFECTIVE}) AS level FROM {{finding}} GROUP BY scan_id) AS v GROUP BY level",
)
_add("top_sources", "SELECT source, count(*) AS findings FROM {finding} GROUP BY source ORDER BY findings DESC, source LIMIT 10")
_add(
    "categories_summary",
    "SELECT scan_id, array_join(array_sort(collect_set(category)), ',') AS categories FROM {finding} GROUP BY scan_id",
    "SELECT scan_id, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM {finding} GROUP BY scan_id",
)
_add("confidence_by_detector", "SELECT detector, round(avg(confidence), 6) AS mean_confidence, count(confidence) AS n FROM {finding} GROUP BY detector")
_add(
    "chain_depth",
    "SELECT cast(coalesce(size(chain), -1) AS bigint) AS depth, count(*) AS n FROM {finding} GROUP BY 1".replace("size(chain)", "CASE WHEN chain IS NULL THEN NULL ELSE size(chain) END"),
    "SELECT cast(coalesce(len(chain), -1) AS bigint) AS depth, count(*) AS n FROM {finding} GROUP BY 1",
)
# ---- windows and interval operators -----------------------------------------------------
# The first of each by a partial aggregation: a source with a third of all findings is one row of each task.
_add(
    "first_finding_per_source",
    "SELECT source, r.finding_id, r.category, r.line FROM (SELECT source, min_by(struct(finding_id, category, line), struct(found_at, finding_id)) AS r FROM {finding} GROUP BY source) AS g",
    "SELECT source, finding_id, category, line FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY found_at, finding_id) AS rn FROM {finding}) AS f WHERE rn = 1",
)
_add(
    "span_merge_islands",
    """SELECT scan_id, min(span_from) AS span_from, max(span_to) AS span_to, count(*) AS merged FROM (
  SELECT scan_id, span_from, span_to, sum(CASE WHEN span_from < coalesce(reach, -1) THEN 0 ELSE 1 END) OVER (PARTITION BY scan_id ORDER BY span_from, span_to DESC, finding_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT scan_id, finding_id, span_from, span_to, max(span_to) OVER (PARTITION BY scan_id ORDER BY span_from, span_to DESC, finding_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM {finding} WHERE span_from IS NOT NULL AND span_to IS NOT NULL) AS a) AS b GROUP BY scan_id, island""",
)
_add(
    "paragraph_offsets",
    """SELECT doc_id, paragraph, cast(coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS offset_chars FROM (
  SELECT doc_id, pos + 1 AS paragraph, char_length(p) AS n FROM {documents} LATERAL VIEW posexplode(split(text, '\\n\\n', -1)) AS pos, p) AS x""",
    """SELECT doc_id, paragraph, cast(coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS offset_chars FROM (
  SELECT doc_id, cast(i AS int) AS paragraph, length(parts[i]) AS n FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS parts FROM {documents} WHERE text IS NOT NULL))) AS x""",
    tables=("documents",),
)
_add(
    "late_findings",
    "SELECT category, count(*) AS late FROM {finding} WHERE loaded_at > found_at + INTERVAL 1 DAY GROUP BY category",
    "SELECT category, count(*) AS late FROM {finding} WHERE loaded_at > found_at + INTERVAL 1 DAY GROUP BY category",
)
# ---- joins ------------------------------------------------------------------------------
_BLOCKED = "(SELECT source FROM {finding} WHERE source IS NOT NULL GROUP BY source HAVING max(" + _IMPACT + ") = 3 AND count(*) >= 20)"
for _name, _spark_join, _duck_join in (("blocklist_semi_join", "LEFT SEMI", "SEMI"), ("blocklist_anti_join", "LEFT ANTI", "ANTI")):
    _text = f"SELECT s.scan_id, s.source FROM {{scan_document}} AS s %s JOIN {_BLOCKED} AS b ON b.source = s.source"
    _add(_name, _text % _spark_join, _text % _duck_join, ("finding", "scan_document"))
# First of each (category, excerpt) by a partial aggregation, so that a hot excerpt is no pile of pairs.
_add(
    "fresh_findings_antijoin",
    """SELECT finding_id, category, source FROM {finding} WHERE excerpt IS NULL UNION ALL
SELECT r.finding_id, r.category, r.source FROM (SELECT min(struct(found_at, finding_id, category, source)) AS r FROM {finding} WHERE excerpt IS NOT NULL GROUP BY category, trim(excerpt)) AS g""",
    "SELECT finding_id, category, source FROM {finding} AS f WHERE NOT EXISTS (SELECT 1 FROM {finding} AS g WHERE g.category = f.category AND trim(g.excerpt) = trim(f.excerpt) AND (g.found_at < f.found_at OR g.found_at = f.found_at AND g.finding_id < f.finding_id))",
)
_add(
    "verdict_cache_join",
    "SELECT s.scan_id, c.first_scan, c.copies FROM {scan_document} AS s JOIN (SELECT sha2(raw, 256) AS h, min(scan_id) AS first_scan, count(*) AS copies FROM {scan_document} WHERE raw IS NOT NULL GROUP BY 1) AS c ON sha2(s.raw, 256) = c.h",
    "SELECT s.scan_id, c.first_scan, c.copies FROM {scan_document} AS s JOIN (SELECT sha256(raw) AS h, min(scan_id) AS first_scan, count(*) AS copies FROM {scan_document} WHERE raw IS NOT NULL GROUP BY 1) AS c ON sha256(s.raw) = c.h",
    tables=("scan_document",),
)
_add("findings_with_documents", "SELECT f.finding_id, s.kind, s.trusted FROM {finding} AS f JOIN {scan_document} AS s ON f.scan_id = s.scan_id", tables=("finding", "scan_document"))
_add(
    "enclosing_findings",
    "SELECT inner_f.finding_id, count(*) AS enclosing FROM {finding} AS inner_f JOIN {finding} AS outer_f ON inner_f.scan_id = outer_f.scan_id AND outer_f.span_from <= inner_f.span_from AND inner_f.span_to <= outer_f.span_to AND inner_f.finding_id <> outer_f.finding_id GROUP BY inner_f.finding_id",
)
# ---- tools: pins, collisions, exposure --------------------------------------------------
# Parts are parted by a zero, as nothing in them is one; a null part is an empty one.
_HASH = "sha2(concat(coalesce(description, ''), char(0), coalesce(input_schema, ''), char(0), coalesce(annotations, '')), 256)"
_DUCK_HASH = "sha256(concat(coalesce(description, ''), chr(0), coalesce(input_schema, ''), chr(0), coalesce(annotations, '')))"
_PINS = """SELECT server, name, snapshot_id, CASE WHEN h = first_value(h) OVER w THEN 'known' ELSE 'changed' END AS state
FROM (SELECT *, {hash} AS h FROM {{tool_snapshot}} WHERE listed) AS t WINDOW w AS (PARTITION BY server, name ORDER BY received_at, snapshot_id)"""
_add("tool_pin_changes", _PINS.format(hash=_HASH), _PINS.format(hash=_DUCK_HASH), tables=("tool_snapshot",))
_add("tool_name_collisions", "SELECT name, count(DISTINCT server) AS servers FROM {tool_snapshot} GROUP BY name HAVING count(DISTINCT server) > 1", tables=("tool_snapshot",))
_add("tool_exposure", "SELECT DISTINCT server, name, concat(server, '__', name) AS exposed FROM {tool_snapshot} WHERE listed ORDER BY exposed", tables=("tool_snapshot",))
# ---- reports ----------------------------------------------------------------------------
_add(
    "text_report",
    f"SELECT finding_id, concat('[', CASE {_IMPACT} WHEN 3 THEN 'critical' WHEN 2 THEN 'medium' WHEN 1 THEN 'base' ELSE 'none' END, '] ', category, ' ', coalesce(detector, '-'), ':', coalesce(cast(line AS string), '?'), ' ', coalesce(message, '')) AS line_text FROM {{finding}}",
    f"SELECT finding_id, concat('[', CASE {_IMPACT} WHEN 3 THEN 'critical' WHEN 2 THEN 'medium' WHEN 1 THEN 'base' ELSE 'none' END, '] ', category, ' ', coalesce(detector, '-'), ':', coalesce(cast(line AS varchar), '?'), ' ', coalesce(message, '')) AS line_text FROM {{finding}}",
)
_add(
    "sarif_results",
    f"SELECT finding_id, category AS rule_id, CASE {_IMPACT} WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'note' END AS sarif_level, greatest(coalesce(line, 1), 1) AS start_line, floor(confidence * 10) / 10 AS confidence FROM {{finding}}",
)
_add("sarif_rules", "SELECT DISTINCT category AS rule_id FROM {finding}")
_add(
    "decision_log_rows",
    "SELECT sha2(cast(scan_id AS string), 256) AS request, count(*) AS findings, least(count(*), 128) AS kept, max(confidence) AS confidence FROM {finding} GROUP BY scan_id",
    "SELECT sha256(cast(scan_id AS varchar)) AS request, count(*) AS findings, least(count(*), 128) AS kept, max(confidence) AS confidence FROM {finding} GROUP BY scan_id",
)
_add(
    "hook_events",
    "SELECT hook_event_name, coalesce(tool_name, '-') AS tool_name, count(*) AS events, count(tool_response) AS answered FROM {hook_input} GROUP BY 1, 2",
    tables=("hook_input",),
)
_add(
    "hook_tool_input",
    "SELECT input_id, get_json_object(tool_input, '$.command') AS command, get_json_object(tool_input, '$.path') AS path, get_json_object(tool_input, '$.query') AS query FROM {hook_input} WHERE tool_input IS NOT NULL",
    "SELECT input_id, json_extract_string(tool_input, '$.command') AS command, json_extract_string(tool_input, '$.path') AS path, json_extract_string(tool_input, '$.query') AS query FROM {hook_input} WHERE tool_input IS NOT NULL",
    tables=("hook_input",),
)
# ---- sanitizing -------------------------------------------------------------------------
_add(
    "warn_wrap",
    "SELECT s.scan_id, concat('[warning: ', v.categories, ' in ', coalesce(s.source, '?'), ']\\n```\\n', replace(s.raw, '```', \"'''\"), '\\n```') AS wrapped FROM {scan_document} AS s JOIN (SELECT scan_id, array_join(array_sort(collect_set(category)), ', ') AS categories FROM {finding} GROUP BY scan_id) AS v ON s.scan_id = v.scan_id WHERE s.raw IS NOT NULL",
    "SELECT s.scan_id, concat('[warning: ', v.categories, ' in ', coalesce(s.source, '?'), ']' || chr(10) || '```' || chr(10), replace(s.raw, '```', chr(39) || chr(39) || chr(39)), chr(10) || '```') AS wrapped FROM {scan_document} AS s JOIN (SELECT scan_id, array_to_string(list_sort(list(DISTINCT category)), ', ') AS categories FROM {finding} GROUP BY scan_id) AS v ON s.scan_id = v.scan_id WHERE s.raw IS NOT NULL",
    tables=("finding", "scan_document"),
)
# ---- set operations ---------------------------------------------------------------------
_add("sources_union", "SELECT source FROM {scan_document} UNION SELECT source FROM {finding}", tables=("finding", "scan_document"))
_add("sources_without_findings", "SELECT source FROM {scan_document} EXCEPT SELECT source FROM {finding}", tables=("finding", "scan_document"))
# ---- extension: event time --------------------------------------------------------------
_add(
    "event_windows",
    "SELECT date_trunc('HOUR', ts) AS hour, event_type, count(*) AS n FROM {events} GROUP BY 1, 2",
    "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM {events} GROUP BY 1, 2",
    tables=("events",),
)
