"""Queries of single-text detectors, scores, redaction and sources, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.regexlang import count, extract_all, java, matches, re2, sql_text
from siftspark.operators import text as T
from siftspark.session import spread, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "kind", "path", "source", "lang"))


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "scan_document").select("scan_id", "source", "kind", "raw"))


def _n(pattern: str, flags: str = "im", column: str = "text") -> str:
    return f"len(regexp_extract_all({column}, {sql_text(re2(pattern, flags))}))"


def _has(pattern: str, flags: str = "im", column: str = "text") -> str:
    return f"regexp_matches({column}, {sql_text(re2(pattern, flags))})"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _counted(name: str, pattern: str, flags: str = "im") -> None:
    """A query that counts a pattern in documents."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _docs(spark, sf_dir).select("doc_id", count(F.col("text"), pattern, flags).cast("long").alias("hits")).where("hits > 0")

    QUERIES[name] = run
    ORACLE[name] = f"SELECT doc_id, {_n(pattern, flags)} AS hits FROM documents WHERE {_n(pattern, flags)} > 0"


for _name, _pattern, _flags in (
    ("hidden_html_comments", T.HTML_COMMENT, "is"),
    ("markdown_comments", T.MARKDOWN_COMMENT, "im"),
    ("css_hidden", T.CSS_HIDDEN, "im"),
    ("letter_spacing", T.LETTER_SPACING, "m"),
    ("broken_words", T.BROKEN_WORD, "m"),
    ("invisible_runes", T.INVISIBLE, ""),
    ("url_decode_candidates", r"(?:%[0-9a-f]{2}){8,}", "i"),
    ("base64_candidates", r"[A-Za-z0-9+/]{40,}={0,2}", ""),
    ("hex_candidates", r"(?:[0-9a-f]{2}[ :,]?){24,}", "i"),
    ("base32_candidates", r"\b[A-Z2-7]{32,}={0,6}", ""),
    ("escape_candidates", r"(?:\\x[0-9a-f]{2}|\\u[0-9a-f]{4}){6,}", "i"),
    ("entity_candidates", r"(?:&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|[a-z]{2,31});){5,}", "i"),
    ("split_literals", r"[\"'][^\"'\n]{1,80}[\"'](?:\s*[+.]\s*[\"'][^\"'\n]{1,80}[\"']){2,}", ""),
):
    _counted(_name, _pattern, _flags)


@_query(f"SELECT doc_id, len(list_filter(regexp_extract_all(text, {sql_text(re2(T.HTML_COMMENT, 'is'))}), lambda x: {_has(T.COMMENT_SPEAKS, 'i', 'x')})) AS comments FROM documents WHERE len(list_filter(regexp_extract_all(text, {sql_text(re2(T.HTML_COMMENT, 'is'))}), lambda x: {_has(T.COMMENT_SPEAKS, 'i', 'x')})) > 0")
def speaking_html_comments(spark, sf_dir):
    """Comments that address a model: DET-09."""
    hits = F.size(F.filter(T.html_comments(F.col("text")), lambda c: matches(c, T.COMMENT_SPEAKS, "i")))
    return _docs(spark, sf_dir).select("doc_id", hits.cast("long").alias("comments")).where("comments > 0")


@_query(f"SELECT scan_id, {_n(T.INVISIBLE, '', 'raw')} AS runes, least(0.5 + {_n(T.INVISIBLE, '', 'raw')} / 40, 0.95) AS confidence FROM scan_document WHERE {_n(T.INVISIBLE, '', 'raw')} >= 3")
def invisible_rune_findings(spark, sf_dir):
    n = count(F.col("raw"), T.INVISIBLE, "").cast("long")
    return _scans(spark, sf_dir).select("scan_id", n.alias("runes")).where("runes >= 3").withColumn("confidence", F.least(0.5 + F.col("runes") / 40, F.lit(0.95)))


_MIXED = r"(regexp_matches(t, '\p{Latin}') AND regexp_matches(t, '[\p{Cyrillic}\p{Greek}\p{Armenian}]') AND length(t) >= 3)"


@_query(f"""SELECT scan_id, len(list_filter(regexp_extract_all(raw, '[^\\t\\n\\f\\r ]+'), lambda t: {_MIXED})) AS tokens FROM scan_document
WHERE len(list_filter(regexp_extract_all(raw, '[^\\t\\n\\f\\r ]+'), lambda t: {_MIXED})) >= 3""")
def mixed_script_density(spark, sf_dir):
    """Words that mix Latin with look-alike scripts, three or more in a document: DET-07."""
    mixed = lambda t: F.rlike(t, F.lit(r"\p{IsLatin}")) & F.rlike(t, F.lit(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}]")) & (F.char_length(t) >= 3)
    n = F.size(F.filter(extract_all(F.col("raw"), r"[^\t\n\f\r ]+", 0, ""), mixed)).cast("long")
    return _scans(spark, sf_dir).select("scan_id", n.alias("tokens")).where("tokens >= 3")


def _lexical_sql(column: str) -> str:
    total = " + ".join(f"CASE WHEN {_has(p, 's', f'lower({column})')} THEN {w} ELSE 0.0 END" for w, p in T.LEXICAL)
    n = _n(r"[^\t\n\x{0B}\f\r ]+", "", column)
    total += f" + CASE WHEN {_has(T.IMPERATIVE, '', f'lower({column})')} AND {n} <= 40 THEN 0.6 ELSE 0.0 END + CASE WHEN {_has(T.SECOND_PERSON, '', f'lower({column})')} THEN 0.4 ELSE 0.0 END"
    total += f" - CASE WHEN {_ratio_sql(column)} > 0.25 THEN 0.5 ELSE 0.0 END"
    return f"CASE WHEN {n} < 3 THEN 0.0 ELSE round(1 / (1 + exp(-(CAST({total} AS DOUBLE) - {T.SHIFT}))), 6) END"


def _ratio_sql(column: str) -> str:
    seen = f"len(regexp_extract_all({column}, '[^\\t\\n\\f\\r ]'))"
    return f"CASE WHEN {seen} > 0 THEN len(regexp_extract_all({column}, '[^\\p{{L}}\\p{{Nd}}\\t\\n\\f\\r ]')) / {seen} ELSE 0.0 END"


@_query(f"SELECT doc_id, {_lexical_sql('text')} AS score FROM documents WHERE text IS NOT NULL")
def lexical_scores(spark, sf_dir):
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", T.lexical_column(F.col("text")).alias("score"))


@_query(f"SELECT doc_id, round({_ratio_sql('text')}, 6) AS ratio, {_n(r'[^\t\n\x{0B}\f\r ]+', '')} AS words FROM documents WHERE text IS NOT NULL")
def symbol_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.round(T.symbol_ratio(F.col("text")), 6).alias("ratio"), T.words(F.col("text")).cast("long").alias("words"))


@_query(f"""WITH p AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10) || chr(10))))) AS paragraph, string_split(text, chr(10) || chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, paragraph, parts[paragraph] AS x FROM p)
SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, {_lexical_sql('x')} AS score FROM s WHERE {_lexical_sql('x')} >= 0.8""")
def paragraph_classifier(spark, sf_dir):
    """Paragraphs that score as instructions, all of each text: DET-14."""
    parts = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("i", "x"))
    scored = parts.select("doc_id", (F.col("i") + 1).cast("long").alias("paragraph"), T.lexical_column(F.col("x")).alias("score"))
    return scored.where("score >= 0.8")


@_query(" UNION ALL ".join(f"SELECT '{label}' AS label, {conf}::DOUBLE AS confidence, count(*) FILTER ({_has(p, 'im', 'raw')}) AS docs, CAST(coalesce(sum({_n(p, 'im', 'raw')}), 0) AS BIGINT) AS hits FROM scan_document" for label, conf, p, _ in T.SECRETS))
def secrets_by_label(spark, sf_dir):
    labels = [label for label, *_ in T.SECRETS]
    wide = _scans(spark, sf_dir).select(*T.secret_counts(F.col("raw")))
    sums = wide.agg(*[F.struct(F.lit(label).alias("label"), F.lit(conf).alias("confidence"), F.count_if(F.col(label) > 0).alias("docs"), F.coalesce(F.sum(label), F.lit(0)).alias("hits")).alias(label) for label, conf, *_ in T.SECRETS])
    return sums.select(F.explode(F.array(*labels)).alias("r")).select("r.*")


def _mask_sql() -> str:
    out = "raw"
    for label, _, pattern, group in T.SECRETS:
        used, by = (T.around_value(pattern), rf"\1[REDACTED:{label}]\2") if group else (pattern, f"[REDACTED:{label}]")
        out = f"regexp_replace({out}, {sql_text(re2(used))}, {sql_text(by)}, 'g')"
    return out


@_query(f"SELECT scan_id, {_mask_sql()} AS masked FROM scan_document WHERE raw IS NOT NULL")
def secret_mask(spark, sf_dir):
    return _scans(spark, sf_dir).where("raw IS NOT NULL").select("scan_id", T.mask_secrets(F.col("raw")).alias("masked"))


@_query(f"SELECT scan_id, unnest(regexp_extract_all(raw, {sql_text(re2(T.secret("url_credentials")))}, 1)) AS value FROM scan_document")
def url_credentials(spark, sf_dir):
    return _scans(spark, sf_dir).select("scan_id", F.explode(extract_all(F.col("raw"), T.secret("url_credentials"), 1)).alias("value"))


_KEYWORDS = ("quartz", "Blue Kestrel")


@_query("SELECT scan_id, " + "regexp_replace(regexp_replace(raw, '(?i)quartz', '[REDACTED:keyword]', 'g'), '(?i)Blue Kestrel', '[REDACTED:keyword]', 'g')" + " AS masked FROM scan_document WHERE regexp_matches(raw, '(?i)quartz|Blue Kestrel')")
def keyword_mask(spark, sf_dir):
    """Literal, case-insensitive deny list: RED-15."""
    out = F.col("raw")
    for word in _KEYWORDS:
        out = F.regexp_replace(out, rf"(?iu)\Q{word}\E", "[REDACTED:keyword]")
    hit = F.rlike(F.col("raw"), F.lit("(?iu)" + "|".join(rf"\Q{w}\E" for w in _KEYWORDS)))
    return _scans(spark, sf_dir).where(hit).select("scan_id", out.alias("masked"))


@_query(f"""WITH v AS (SELECT scan_id, unnest(regexp_extract_all(raw, {sql_text(re2(T.secret("generic_secret")))}, 1)) AS value FROM scan_document)
SELECT scan_id, value FROM v WHERE NOT contains(value, 'sk_test') AND NOT contains(value, 'npm_')""")
def allowlist_filter(spark, sf_dir):
    """Matches whose value contains no allowed string: RED-23."""
    allowed = F.array(F.lit("sk_test"), F.lit("npm_"))
    values = _scans(spark, sf_dir).select("scan_id", F.explode(extract_all(F.col("raw"), T.secret("generic_secret"), 1)).alias("value"))
    return values.where(~F.exists(allowed, lambda a: F.contains(F.col("value"), a)))


_TOKEN = r"[A-Za-z0-9+/=_-]{20,}"


@_query(f"""WITH t AS (SELECT scan_id, unnest(regexp_extract_all(raw, '{_TOKEN}')) AS token FROM scan_document),
h AS (SELECT DISTINCT scan_id, token, list_histogram(string_split(token, '')) AS n FROM (SELECT * FROM t)),
e AS (SELECT scan_id, token, round(list_sum([-(x / length(token)::DOUBLE) * log2(x / length(token)::DOUBLE) for x in map_values(n)]), 6) AS bits FROM h WHERE regexp_matches(token, '[A-Za-z]') AND regexp_matches(token, '[0-9]'))
SELECT scan_id, token, bits FROM e WHERE bits >= 4.2""".replace("list_histogram(string_split(token, ''))", "list_aggregate(string_split(token, ''), 'histogram')"))
def shannon_entropy(spark, sf_dir):
    """Long tokens with letters and digits and an entropy over the threshold: RED-16."""
    tokens = _scans(spark, sf_dir).select("scan_id", F.explode(extract_all(F.col("raw"), _TOKEN, 0, "")).alias("token")).distinct()
    mixed = F.rlike("token", F.lit("[A-Za-z]")) & F.rlike("token", F.lit("[0-9]"))
    return tokens.where(mixed).withColumn("bits", F.round(T.entropy(F.col("token")), 6)).where("bits >= 4.2")


@_query("""SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') AS decoded FROM documents
WHERE strlen(text) BETWEEN 40 AND 65536 AND NOT (""" + " OR ".join(f"contains(lower(text), '{w}')" for w in T.STOP_WORDS) + ") AND (" + " + ".join(f"contains(lower(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')), '{w}')::INT" for w in T.STOP_WORDS) + ") >= 2")
def rot13_views(spark, sf_dir):
    decoded = T.rot13(F.col("text"))
    plain = lambda c: [F.contains(F.lower(c), F.lit(w)) for w in T.STOP_WORDS]
    none = ~F.exists(F.array(*plain(F.col("text"))), lambda b: b)
    two = sum((b.cast("int") for b in plain(decoded)), F.lit(0)) >= 2
    return _docs(spark, sf_dir).where(F.octet_length("text").between(40, 65536) & none & two).select("doc_id", decoded.alias("decoded"))


def _ends(column: str, names) -> str:
    return "(" + " OR ".join(f"ends_with({column}, '{n}')" for n in names) + ")"


@_query(f"""WITH l AS (SELECT '/' || replace(path, chr(92), '/') AS p FROM documents WHERE path IS NOT NULL UNION ALL SELECT '/' || replace(source, chr(92), '/') FROM scan_document WHERE source IS NOT NULL),
k AS (SELECT CASE WHEN {_ends('lower(p)', T.IMAGE_ENDS)} THEN 'image' WHEN {_ends('p', ['/' + n for n in T.CONFIG_FILES])} THEN 'agent_config'
 WHEN {_ends('p', ['/' + n for n in T.INSTRUCTION_FILES])} OR {' OR '.join(f"contains(p, '/{f}')" for f in T.INSTRUCTION_FOLDERS)} THEN 'instructions' ELSE 'file' END AS kind FROM l)
SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def path_kind_classifier(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select("path").unionAll(table(spark, sf_dir, "scan_document").select("source")).where("path IS NOT NULL")
    return paths.groupBy(T.path_kind(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"""SELECT doc_id, CASE WHEN {_has(T.REVIEWER)} THEN 0.9 ELSE 0.75 END::DOUBLE AS confidence FROM documents WHERE {_has(T.FRAMING)}""")
def abort_bait_framing(spark, sf_dir):
    return _docs(spark, sf_dir).where(matches(F.col("text"), T.FRAMING)).select("doc_id", F.when(matches(F.col("text"), T.REVIEWER), 0.9).otherwise(0.75).alias("confidence"))


@_query("""SELECT doc_id, json_exists(text, '$.hooks') AS hooks, json_exists(text, '$.mcpServers') AS servers FROM documents WHERE kind = 'agent_config' AND json_valid(text) AND (json_exists(text, '$.hooks') OR json_exists(text, '$.mcpServers'))""")
def agent_config_hooks(spark, sf_dir):
    """Agent configuration with hooks or servers: DET-13."""
    has = lambda k: F.get_json_object("text", f"$.{k}").isNotNull()
    return _docs(spark, sf_dir).where((F.col("kind") == "agent_config") & (has("hooks") | has("mcpServers"))).select("doc_id", has("hooks").alias("hooks"), has("mcpServers").alias("servers"))
