"""Reports, logs and state as tables and files: written by all executors, replaced as a whole, and merged by key.

A report is a table of numbered lines. Its parts are written in order, so the files one after the other are the document, whatever its size.
Reports read their verdicts several times: give them a written table or a checkpoint.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.operators.rules import level_name

#: Findings a decision lists; it counts all.
LISTED = 128


def _lines(body: DataFrame, order: list[str], line: Column, head: str | None, foot: DataFrame) -> DataFrame:
    """part (0, 1, 2), order, line: a head, the body's lines, a foot."""
    spark = body.sparkSession
    own = body.select(F.lit(1).alias("part"), F.struct(*order).cast("string").alias("place"), line.alias("line"))
    out = own if head is None else spark.createDataFrame([(0, "", head)], "part int, place string, line string").unionByName(own)
    return out.unionByName(foot.select(F.lit(2).alias("part"), F.lit("").alias("place"), "line"))


def _after_first(first: str | None) -> Column:
    """Each line but the first behind a comma."""
    return F.when(F.col("at") == F.lit(first), F.col("line")).otherwise(F.concat(F.lit(","), "line"))


def text_report(verdicts: DataFrame, key: str) -> DataFrame:
    """Lines of a report over verdicts (key, source, level, action, findings): those with findings, each followed by them, the number of documents and the highest level at the end."""
    found = verdicts.where(F.size("findings") > 0)
    where = lambda f: F.concat(F.coalesce(f.detector, F.lit("-")), F.when(f.line > 0, F.concat(F.lit(":"), f.line.cast("string"))).otherwise(""), F.when(F.size(f.chain) > 0, F.concat(F.lit(" via ["), F.array_join(f.chain, " "), F.lit("]"))).otherwise(""))
    one = lambda f: F.concat(F.lit("    "), F.rpad(level_name(f.level), 8, " "), F.lit(" "), F.rpad(f.category, F.greatest(F.lit(20), F.length(f.category)), " "), F.lit(" "), F.format_number(f.confidence, 2), F.lit(" "), where(f))
    head = F.concat(F.rpad(level_name(F.col("level")), 8, " "), F.lit(" "), F.rpad(F.col("action"), 8, " "), F.lit(" "), F.coalesce("source", F.lit("-")))
    lines = found.select(key, F.posexplode(F.concat(F.array(head), F.transform("findings", one))).alias("no", "line"))
    foot = verdicts.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("findings") > 0).alias("w"), F.coalesce(F.max("level"), F.lit(0)).alias("m")).select(
        F.concat(F.lit("\n"), F.col("n").cast("string"), F.lit(" files scanned, "), F.col("w").cast("string"), F.lit(" with findings, max level: "), level_name(F.col("m"))).alias("line")
    )
    return _lines(lines.withColumn("at", F.format_string("%020d%06d", key, "no")), ["at"], F.col("line"), None, foot)


def json_report(verdicts: DataFrame, key: str) -> DataFrame:
    """Lines of a report as JSON: scanned, level, and the verdicts with findings, one on a line."""
    found = verdicts.where(F.size("findings") > 0)
    body = found.select(F.format_string("%020d", key).alias("at"), F.to_json(F.struct("source", level_name(F.col("level")).alias("level"), "action", "findings")).alias("line"))
    total = verdicts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("level"), F.lit(0)).alias("m"))
    first = body.agg(F.min("at")).first()[0]
    foot = total.select(F.concat(F.lit('],"scanned":'), F.col("n").cast("string"), F.lit(',"level":"'), level_name(F.col("m")), F.lit('"}')).alias("line"))
    return _lines(body, ["at"], _after_first(first), '{"verdicts":[', foot)


# Fixed values of the format.
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"


def sarif_report(verdicts: DataFrame, key: str) -> DataFrame:
    """Lines of a SARIF document: each category once as a rule, each finding as a result. The categories are few, the results may be any number."""
    each = verdicts.select(key, "source", "action", F.posexplode("findings").alias("no", "f"))
    rules = [r[0] for r in each.select("f.category").distinct().orderBy("category").limit(1000).collect()]
    level = F.when(F.col("f.level") == 3, "error").when(F.col("f.level") == 2, "warning").otherwise("note")
    message = F.concat(F.coalesce("f.excerpt", F.lit("")), F.lit(" ("), F.coalesce("f.detector", F.lit("-")), F.lit(", confidence "), F.format_number(F.floor(F.col("f.confidence") * 10) / 10, 1), F.lit(", action "), "action", F.lit(")"))
    place = F.array(F.struct(F.struct(F.struct(F.coalesce("source", F.lit("-")).alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("f.line", F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation")))
    result = F.to_json(F.struct(F.col("f.category").alias("ruleId"), level.alias("level"), F.struct(message.alias("text")).alias("message"), place.alias("locations")))
    lines = each.select(F.format_string("%020d%06d", key, "no").alias("at"), result.alias("line"))
    first = lines.agg(F.min("at")).first()[0]
    driver = {"name": "siftspark", "rules": [{"id": r, "name": r, "shortDescription": {"text": r}} for r in rules]}
    head = json.dumps({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION})[:-1] + ', "runs": [{"tool": ' + json.dumps({"driver": driver}) + ', "results": ['
    foot = verdicts.sparkSession.createDataFrame([("]}]}",)], "line string")
    return _lines(lines, ["at"], _after_first(first), head, foot)


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines of a report as text files whose names sort in its order."""
    lines.orderBy("part", "place").select("line").write.mode("overwrite").text(path)


# ---- decisions --------------------------------------------------------------------------
def decision_rows(decided: DataFrame, request: Column, schema: str = "siftspark-decision-v1") -> DataFrame:
    """Rows of the decision log: schema, hash of the request, action, delivery, reason, scope, level, the first :data:`LISTED` findings without text, and how many there are."""
    shown = F.transform(F.slice("findings", 1, LISTED), lambda f: F.struct(f.detector.alias("detector"), f.category.alias("category"), level_name(f.level).alias("level"), f.confidence.alias("confidence")))
    return decided.select(
        F.lit(schema).alias("schema"), F.sha2(request.cast("string"), 256).alias("request_sha256"), "action", "delivery", "reason", "scope", "level", shown.alias("findings"), F.size("findings").alias("finding_count"), "suppressed"
    )


# ---- state ------------------------------------------------------------------------------
def replace(df: DataFrame, root: str) -> str:
    """A new version of a table beside the old ones, and its name put in ``root``/current as the last step, so readers see the old or the new one whole."""
    spark = df.sparkSession
    at = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(at)
    spark.createDataFrame([(at,)], "at string").coalesce(1).write.mode("overwrite").json(f"{root.rstrip('/')}/current")
    return at


def current(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The table of the last :func:`replace`; empty if there was none. A name that can't be read is an error, not an empty table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/current")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    try:
        at = [r.at for r in spark.read.schema("at string").json(f"{root.rstrip('/')}/current").collect()]
    except Exception as e:
        raise ValueError(f"the state under {root} can't be read") from e
    if len(at) != 1 or not at[0]:
        raise ValueError(f"the state under {root} can't be read")
    return spark.read.schema(schema).parquet(at[0])


STATS = "scope string, kind string, name string, n long, first_seen timestamp, last_seen timestamp"


def stats_of(verdicts: DataFrame, scope: str) -> DataFrame:
    """Counters of verdicts (source, level, action, findings, at): documents, findings, each action but pass, and counts by category, level and source, as rows of :data:`STATS`. Null sources aren't counted by source."""
    found = F.size("findings") > 0
    kinds = F.concat(
        F.array(F.struct(F.lit("total").alias("kind"), F.lit("documents").alias("name"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("total").alias("kind"), F.lit("findings").alias("name"), F.size("findings").cast("long").alias("n"))),
        F.filter(F.array(F.struct(F.lit("total").alias("kind"), F.when(found & (F.col("action") != "pass"), F.element_at(F.create_map(F.lit("block"), F.lit("blocked"), F.lit("sanitize"), F.lit("sanitized"), F.lit("warn"), F.lit("warned")), F.col("action"))).alias("name"), F.lit(1).cast("long").alias("n"))), lambda x: x["name"].isNotNull()),
        F.filter(F.array(F.struct(F.lit("level").alias("kind"), F.when(found, level_name(F.col("level"))).alias("name"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("source").alias("kind"), F.when(found, F.col("source")).alias("name"), F.lit(1).cast("long").alias("n"))), lambda x: x["name"].isNotNull()),
        F.transform("findings", lambda f: F.struct(F.lit("category").alias("kind"), f.category.alias("name"), F.lit(1).cast("long").alias("n"))),
    )
    each = verdicts.select("at", F.explode(kinds).alias("k")).select("at", "k.*")
    return each.groupBy("kind", "name").agg(F.sum("n").alias("n"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen")).select(F.lit(scope).alias("scope"), "kind", "name", "n", "first_seen", "last_seen")


def merge_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counters added up by scope, kind and name."""
    return old.unionByName(new).groupBy("scope", "kind", "name").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def reset_stats(stats: DataFrame, scope: str) -> DataFrame:
    """The counters without a scope's."""
    return stats.where(F.col("scope") != scope)


def rendered_stats(stats: DataFrame, most: int = 10) -> DataFrame:
    """scope, kind, place, name, n: counters by number and then by name; of sources the first ``most``."""
    by_number = Window.partitionBy("scope", "kind").orderBy(F.desc("n"), "name")
    ranked = lambda df: df.withColumn("place", F.row_number().over(by_number)).select("scope", "kind", "place", "name", "n")
    # Sources may be any number: the limit on the rank is applied before the shuffle too. All other names are few.
    return ranked(stats.where("kind = 'source'")).where(F.col("place") <= most).unionByName(ranked(stats.where("kind <> 'source'")))


def merge_blocklist(stored: DataFrame, pending: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """source, reason, at: the stored entries and the pending ones, which win; without those an operator removed. Null and empty sources are no entries."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(pending.withColumn("__new", F.lit(1))).where("source IS NOT NULL AND source <> ''")
    one = both.groupBy("source").agg(F.max_by(F.struct("reason", "at"), F.struct("__new", "at", "reason")).alias("e")).select("source", "e.reason", "e.at")
    return one if removed is None else one.join(removed.select("source").distinct(), "source", "left_anti")


def merge_pins(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """tool, hash: the first hash of each tool for ever; of those seen (tool, hash, at) the earliest."""
    first = seen.where("tool IS NOT NULL AND hash IS NOT NULL").groupBy("tool").agg(F.min_by("hash", F.struct("at", "hash")).alias("hash"))
    return stored.unionByName(first.join(stored.select("tool"), "tool", "left_anti"))
