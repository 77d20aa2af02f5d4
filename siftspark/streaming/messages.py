"""A stream of messages, one JSON object on a line: requests, responses, notifications, and what is passed on of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notifications that are passed on: those that say that a list has changed.
FORWARDED = r"^notifications/(?:tools|resources|prompts)/list_changed$"


def parsed(line: Column) -> Column:
    """(kind, id, method, params, result, error) of a line; kind is request, notification, response or invalid. Ids keep their JSON form, so 1 and "1" differ."""
    get = lambda k: F.get_json_object(line, f"$.{k}")
    raw = F.from_json(line, "jsonrpc string, id string, method string, params string, result string, error string")
    text_id = F.rlike(line, F.lit(r'"id"\s*:\s*"'))
    ident = F.when(get("id").isNotNull(), F.when(text_id, F.to_json(F.struct(get("id").alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(get("id").alias("x")))) - 6)).otherwise(get("id")))
    answered = get("result").isNotNull() | get("error").isNotNull()
    kind = (
        F.when(raw.isNull() | (get("jsonrpc") != "2.0") | get("jsonrpc").isNull(), "invalid")
        .when(get("method").isNotNull() & get("id").isNotNull(), "request")
        .when(get("method").isNotNull(), "notification")
        .when(get("id").isNotNull() & answered, "response")
        .otherwise("invalid")
    )
    return F.struct(kind.alias("kind"), ident.alias("id"), get("method").alias("method"), get("params").alias("params"), get("result").alias("result"), get("error").alias("error"))


def messages(lines: DataFrame, line: str = "value") -> DataFrame:
    """The messages of a batch or stream of lines, beside their further columns; blank lines are none. Stateless, so each is answered as it comes."""
    rest = [c for c in lines.columns if c != line]
    return lines.where(F.trim(line) != "").select(*rest, parsed(F.col(line)).alias("m")).select(*rest, "m.*")


def forwarded(messages: DataFrame) -> DataFrame:
    """Notifications that are passed on; all others are dropped."""
    return messages.where((F.col("kind") == "notification") & F.rlike("method", F.lit(FORWARDED)))


def framed(ident: Column, result: Column) -> Column:
    """The line that answers a request: ``ident`` and ``result`` are JSON."""
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), ident, F.lit(',"result":'), result, F.lit("}"))


def first_of_each(rows: DataFrame, content: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each content: later ones with the same content take their verdict from it (a cache). On a stream, contents are remembered for as long as rows may be late."""
    hashed = rows.withColumn("content_hash", F.sha2(F.coalesce(content, F.lit("")), 256))
    return hashed.withWatermark(at, late).dropDuplicatesWithinWatermark(["content_hash"]) if rows.isStreaming else hashed.dropDuplicates(["content_hash"])
