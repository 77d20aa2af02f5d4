"""Queries of the operators over whole documents, results, tools and requests. Where SQL can say the same, it is given; the rest have case tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.api import Scanner
from siftspark.functions.regexlang import re2, sql_text
from siftspark.operators import classifier, combine, context, redact, results, scan, tools
from siftspark.operators.mentions import mentions
from siftspark.operators.policy import BALANCED, judged
from siftspark.operators.rules import impact
from siftspark.plans.report_queries import _DUCK_HASH, _IMPACT
from siftspark.session import cut_lineage, spread, table
from siftspark.sources import sinks
from siftspark.streaming.messages import first_of_each

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _hooks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "hook_input").select("input_id", *columns).dropDuplicates(["input_id"])


# ---- scan and reports -------------------------------------------------------------------
def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over the scanned items, under the balanced policy."""
    return Scanner(BALANCED).scan_documents(table(spark, sf_dir, "scan_document"), "scan_id", "raw")


@_query()
def scan_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("scan_id", "level", "action", F.size("findings").alias("findings"), F.transform("findings", lambda f: f.category).alias("categories"))


@_query()
def scan_report_text(spark, sf_dir):
    return sinks.text_report(cut_lineage(_verdicts(spark, sf_dir)), "scan_id")


@_query()
def scan_report_json(spark, sf_dir):
    return sinks.json_report(cut_lineage(_verdicts(spark, sf_dir)), "scan_id")


@_query()
def scan_report_sarif(spark, sf_dir):
    return sinks.sarif_report(cut_lineage(_verdicts(spark, sf_dir)), "scan_id")


@_query()
def scan_stats(spark, sf_dir):
    dated = _verdicts(spark, sf_dir).join(table(spark, sf_dir, "scan_document").select("scan_id", F.col("scanned_at").alias("at")), "scan_id")
    return sinks.rendered_stats(sinks.stats_of(dated, "scan"))


@_query()
def spread_findings(spark, sf_dir):
    """Weak signals by project, which is the first folder of a source."""
    scans = table(spark, sf_dir, "scan_document")
    found = scan.scanned(scans, "scan_id", "raw").withColumn("quiet", judged(F.col("findings"), F.col("trusted"), BALANCED)["suppressed"])
    weak = found.select(F.element_at(F.split("source", "/"), 1).alias("project"), "source", F.explode("quiet").alias("f")).select("project", "source", "f.*")
    return combine.spread_signals(weak, "project", "source")


@_query()
def joined_instructions(spark, sf_dir):
    """Findings that only a project's instruction files together show; a project is the first folder."""
    files = spread(table(spark, sf_dir, "scan_document").where("kind = 'instructions'").select("source", "raw")).withColumn("project", F.element_at(F.split("source", "/"), 1))
    own = files.select("project", F.explode(scan.findings_of(F.col("raw"), F.lit("instructions"), F.col("source"))).alias("f")).select("project", "f.category", "f.excerpt")
    return combine.joined_findings(files, "project", "source", "raw", own)


@_query()
def session_context(spark, sf_dir):
    """What is added at a session's start, by project."""
    files = table(spark, sf_dir, "scan_document").where("kind = 'instructions'").groupBy("source").agg(F.max_by("raw", F.struct("scanned_at", "scan_id")).alias("raw"))
    blocked = table(spark, sf_dir, "finding").where("level = 'critical' AND confidence >= 0.9").select("source").distinct()
    return results.session_start(files.withColumn("project", F.element_at(F.split("source", "/"), 1)), "project", "source", "raw", blocked)


# ---- privacy ----------------------------------------------------------------------------
@_query()
def masked_texts(spark, sf_dir):
    """Scanned texts with secrets, Russian names and mobile numbers hidden; what can't be inspected has no text."""
    rows = spread(table(spark, sf_dir, "scan_document").select("scan_id", "raw"))
    return rows.select("scan_id", redact.masked(F.col("raw")).alias("m")).select("scan_id", "m.ok", "m.text", "m.labels")


@_query()
def masked_tools(spark, sf_dir):
    """Tool definitions without personal data."""
    rows = spread(table(spark, sf_dir, "tool_snapshot").select("snapshot_id", "name", "description", "input_schema", "annotations"))
    return rows.select("snapshot_id", tools.masked_tools(*map(F.col, ("name", "description", "input_schema", "annotations"))).alias("t")).select("snapshot_id", "t.*")


# ---- hooks ------------------------------------------------------------------------------
@_query()
def hook_rewrites(spark, sf_dir):
    """What each tool response becomes."""
    rows = _hooks(spark, sf_dir, "tool_name", "tool_input", "tool_response", "hook_event_name").where("hook_event_name = 'PostToolUse'")
    return rows.select("input_id", results.post_tool_uses(F.col("tool_name"), F.col("tool_input"), F.col("tool_response"), masking=True).alias("p")).select("input_id", "p.*")


@_query()
def session_worst_level(spark, sf_dir):
    """The highest level of any string of a session's tool responses."""
    rows = _hooks(spark, sf_dir, "session_id", "tool_name", "tool_input", "tool_response")
    level = results.post_tool_uses(F.col("tool_name"), F.col("tool_input"), F.col("tool_response"))["level"]
    return rows.select("session_id", level.alias("level")).groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), F.max("level").alias("worst"))


# Blocked are the file names, with their folder, of sources with a critical finding.
_BLOCKED = f"SELECT DISTINCT regexp_extract(source, '[^/]+/[^/]+$') AS source FROM finding WHERE {_IMPACT} = 3"
_FIELDS = ", ".join(f"json_extract_string(tool_input, '$.{f}')" for f in results.LOOKED_AT)


@_query(f"""WITH b AS ({_BLOCKED}), h AS (SELECT DISTINCT input_id, unnest([{_FIELDS}]) AS value FROM hook_input WHERE tool_input IS NOT NULL)
SELECT input_id, min(b.source) AS source FROM h JOIN b ON b.source <> '' AND contains(h.value, b.source) GROUP BY input_id""")
def pre_tool_denials(spark, sf_dir):
    """Events whose input names a blocked source."""
    blocked = table(spark, sf_dir, "finding").where(impact(F.col("category")) == 3).select(F.regexp_extract("source", "[^/]+/[^/]+$", 0).alias("source"))
    return results.pre_tool_use(_hooks(spark, sf_dir, "tool_input"), blocked).select("input_id", "source")


# ---- tools ------------------------------------------------------------------------------
@_query("SELECT DISTINCT t.server, t.name, lower(o.server) AS mentions FROM tool_snapshot AS t JOIN (SELECT DISTINCT server FROM tool_snapshot) AS o ON lower(o.server) <> lower(t.server) AND o.server <> '' AND contains(lower(t.description), lower(o.server))")
def tool_cross_origin(spark, sf_dir):
    """Tools whose description names another server."""
    rows = table(spark, sf_dir, "tool_snapshot").select("server", "name", F.array(F.lower("description")).alias("texts")).distinct()
    servers = table(spark, sf_dir, "tool_snapshot").select(F.lower("server").alias("server"))
    return mentions(rows, servers, "texts", "mentions").where("mentions <> lower(server)").distinct()


@_query(f"""WITH l AS (SELECT server, name, description, received_at, snapshot_id, {_DUCK_HASH} AS h FROM tool_snapshot WHERE listed AND name IS NOT NULL AND server IS NOT NULL),
a AS (SELECT server, name, h AS first_hash FROM l QUALIFY row_number() OVER (PARTITION BY server, name ORDER BY received_at, snapshot_id) = 1),
z AS (SELECT server, name, h AS last_hash, coalesce(regexp_matches(description, {sql_text(re2(tools.STEERS, "i"))}), false) AS steering FROM l QUALIFY row_number() OVER (PARTITION BY server, name ORDER BY received_at DESC, snapshot_id DESC) = 1),
n AS (SELECT name, count(DISTINCT server) > 1 AS shared FROM z GROUP BY name)
SELECT z.server, z.name, last_hash <> first_hash AS changed, steering, shared, CAST((last_hash <> first_hash)::INT + steering::INT + shared::INT AS INT) AS warnings FROM z JOIN a USING (server, name) JOIN n USING (name)""")
def tool_integrity(spark, sf_dir):
    """The last listing of each tool against its first one."""
    listed = table(spark, sf_dir, "tool_snapshot").where("listed AND name IS NOT NULL AND server IS NOT NULL")
    fields = F.struct("description", "input_schema", "annotations")
    by = listed.groupBy("server", "name").agg(F.min_by(fields, F.struct("received_at", "snapshot_id")).alias("first"), F.max_by(fields, F.struct("received_at", "snapshot_id")).alias("last"))
    pins = by.select(F.concat_ws("/", "server", "name").alias("tool"), tools.tool_hash(F.col("first.description"), F.col("first.input_schema"), F.col("first.annotations")).alias("hash"))
    return tools.integrity(by.select("server", "name", "last.*"), pins).select("server", "name", "changed", "steering", "shared", F.size("warnings").alias("warnings"))


@_query(f"""SELECT server, name, 'changed' AS warning, min(received_at) AS first_warned FROM (SELECT *, {_DUCK_HASH} AS h, first_value({_DUCK_HASH}) OVER (PARTITION BY server, name ORDER BY received_at, snapshot_id) AS pin FROM tool_snapshot WHERE listed) AS t WHERE h <> pin GROUP BY server, name
UNION ALL SELECT server, name, 'steering', min(received_at) FROM tool_snapshot WHERE listed AND regexp_matches(description, {sql_text(re2(tools.STEERS, "i"))}) GROUP BY server, name""")
def tool_warn_once(spark, sf_dir):
    """Each warning of a tool once, at the first listing that gives it: its definition changed, or its description steers other tools."""
    listed = table(spark, sf_dir, "tool_snapshot").where("listed").withColumn("hash", tools.tool_hash(F.col("description"), F.col("input_schema"), F.col("annotations")))
    pins = listed.groupBy("server", "name").agg(F.min_by("hash", F.struct("received_at", "snapshot_id")).alias("pin"))
    changed = listed.join(pins, ["server", "name"]).where("hash <> pin").groupBy("server", "name").agg(F.lit("changed").alias("warning"), F.min("received_at").alias("first_warned"))
    steering = listed.where(tools.steers(F.col("description"))).groupBy("server", "name").agg(F.lit("steering").alias("warning"), F.min("received_at").alias("first_warned"))
    return changed.unionByName(steering)


# ---- requests, classifiers, caches ------------------------------------------------------
@_query()
def context_analysis(spark, sf_dir):
    """Contextual analysis of each request, with the backend that needs no model."""
    return context.analyzed(table(spark, sf_dir, "context_document"), context.LexicalBackend())


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, and whether a label says that they are on software."""
    labels = table(spark, sf_dir, "subject_label").where("subject IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("subject") == "software", 1.0).otherwise(0.0)).alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")


@_query()
def trained_classifier(spark, sf_dir):
    """Held-out quality of the trained classifier: of the rows not fitted on, by label, how many there are and how many it gives .5 or more."""
    rows = _labelled(spark, sf_dir)
    held_out = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
    model = classifier.fit(rows.where(~held_out), "doc_id", "text", "label")
    test = rows.where(held_out & F.col("text").isNotNull()).select("label", classifier.scored(model, F.col("text")).alias("score"))
    return test.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score") >= 0.5).alias("positive"), F.round(F.avg("score"), 3).alias("mean"))


@_query()
def gated_classifier(spark, sf_dir):
    """Lexical scores, and the trained classifier's where those are high enough."""
    model = classifier.fit(_labelled(spark, sf_dir), "doc_id", "text", "label")
    return classifier.gated_scores(spread(table(spark, sf_dir, "scan_document").select("scan_id", "raw")), "scan_id", "raw", model)


@_query("SELECT count(*) AS contents FROM (SELECT DISTINCT coalesce(description, '') FROM tool_snapshot)")
def description_cache(spark, sf_dir):
    """Different descriptions: each is judged once, and its verdict taken for the others."""
    return first_of_each(table(spark, sf_dir, "tool_snapshot").select("description", "received_at"), "description", "received_at").agg(F.count(F.lit(1)).alias("contents"))


@_query("""WITH f AS (SELECT DISTINCT ON (finding_id) * FROM finding), r AS (SELECT scan_id, finding_id, category, row_number() OVER (PARTITION BY scan_id ORDER BY finding_id) AS place, count(*) OVER (PARTITION BY scan_id) AS finding_count FROM f)
SELECT sha256(CAST(scan_id AS VARCHAR)) AS request_sha256, finding_id, category, finding_count FROM r WHERE place <= 128""")
def decision_log(spark, sf_dir):
    """The first findings a decision lists, beside how many there are."""
    rows = table(spark, sf_dir, "finding").select("scan_id", "finding_id", "category").dropDuplicates(["finding_id"])
    by_scan = Window.partitionBy("scan_id")
    ranked = rows.withColumns({"place": F.row_number().over(by_scan.orderBy("finding_id")), "finding_count": F.count(F.lit(1)).over(by_scan)})
    return ranked.where(F.col("place") <= sinks.LISTED).select(F.sha2(F.col("scan_id").cast("string"), 256).alias("request_sha256"), "finding_id", "category", "finding_count")
