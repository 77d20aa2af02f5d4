"""Queries of the history operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators.history import tool_ledger, tool_versions
from siftspark.session import table

_FORMAT = "yyyy-MM-dd HH:mm:ss"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tool_versions(table(spark, sf_dir, "tool_snapshot"))
    return found.select(
        "server",
        "name",
        F.date_format("valid_from", _FORMAT).alias("valid_from"),
        F.coalesce(F.date_format("valid_to", _FORMAT), F.lit("open")).alias("valid_to"),
    ).distinct()


def p1_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bitemporal ledger, superseded rows included."""
    return tool_ledger(table(spark, sf_dir, "tool_snapshot")).select(
        "server", "name", "description", "input_schema", "listed", "valid_from", "valid_to", "recorded_from", "recorded_to", "current"
    )


QUERIES = {"p1_found": p1_found, "p1_ledger": p1_ledger}

#: What the ledger holds, by the definition: each row an update and a time at which the next update known after it fell.
LEDGER_SQL = """
WITH u AS (
  SELECT snapshot_id, server, name, description, input_schema, listed, seen_at AS v, received_at AS r
  FROM tool_snapshot WHERE seen_at IS NOT NULL AND received_at IS NOT NULL
), changes AS (
  SELECT a.snapshot_id, a.r AS t FROM u a
  UNION
  SELECT a.snapshot_id, b.r AS t FROM u a JOIN u b
    ON a.server IS NOT DISTINCT FROM b.server AND a.name IS NOT DISTINCT FROM b.name AND b.v >= a.v AND b.r > a.r
), states AS (
  SELECT a.*, c.t,
    (SELECT min(b.v) FROM u b WHERE a.server IS NOT DISTINCT FROM b.server AND a.name IS NOT DISTINCT FROM b.name
       AND b.v > a.v AND b.r <= c.t) AS valid_to,
    EXISTS (SELECT 1 FROM u b WHERE a.server IS NOT DISTINCT FROM b.server AND a.name IS NOT DISTINCT FROM b.name
       AND b.v = a.v AND b.r <= c.t AND (b.r, b.snapshot_id) > (a.r, a.snapshot_id)) AS dead
  FROM u a JOIN changes c USING (snapshot_id)
), steps AS (
  SELECT *, lag(valid_to) OVER w AS was, row_number() OVER w AS n FROM states WINDOW w AS (PARTITION BY snapshot_id ORDER BY t)
), kept AS (
  SELECT *, lead(t) OVER (PARTITION BY snapshot_id ORDER BY t) AS recorded_to
  FROM (SELECT *, lag(dead) OVER (PARTITION BY snapshot_id ORDER BY t) AS was_dead FROM steps)
  WHERE n = 1 OR dead AND NOT was_dead OR NOT dead AND valid_to IS DISTINCT FROM was
)
SELECT server, name, description, input_schema, listed, v AS valid_from, valid_to, t AS recorded_from, recorded_to,
  recorded_to IS NULL AS current
FROM kept WHERE NOT dead
"""

#: Versions by the definition: values filled from the listed rows before, schemas compared by their values in any order, a version at each change.
FOUND_SQL = r"""
WITH d AS (SELECT DISTINCT ON (server, name, seen_at) server, name, seen_at, description, input_schema, listed FROM tool_snapshot ORDER BY server, name, seen_at, received_at DESC, snapshot_id DESC),
f AS (SELECT *, last_value(CASE WHEN listed THEN description END IGNORE NULLS) OVER w AS de, last_value(CASE WHEN listed THEN input_schema END IGNORE NULLS) OVER w AS sc FROM d
  WINDOW w AS (PARTITION BY server, name ORDER BY seen_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT DISTINCT sc FROM f WHERE json_valid(sc)),
c AS (SELECT s.sc, string_agg(t.fullkey || '=' || CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'n' || CAST(CAST(t.atom AS DOUBLE) AS VARCHAR) ELSE t.type || coalesce(CAST(t.atom AS VARCHAR), '') END, chr(10) ORDER BY t.fullkey) AS canon FROM s, json_tree(s.sc) AS t GROUP BY s.sc),
v AS (SELECT f.*, coalesce(c.canon, f.sc) AS canon FROM f LEFT JOIN c ON c.sc = f.sc),
m AS (SELECT *, listed AND (coalesce(lag(listed) OVER w, false) = false OR de IS DISTINCT FROM lag(de) OVER w OR canon IS DISTINCT FROM lag(canon) OVER w) AS starts FROM v WINDOW w AS (PARTITION BY server, name ORDER BY seen_at)),
b AS (SELECT *, lead(seen_at) OVER (PARTITION BY server, name ORDER BY seen_at) AS until FROM m WHERE starts OR NOT listed)
SELECT server, name, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS valid_from, coalesce(strftime(until, '%Y-%m-%d %H:%M:%S'), 'open') AS valid_to FROM b WHERE starts
"""

ORACLE = {"p1_ledger": LEDGER_SQL, "p1_found": FOUND_SQL}
