"""What only several files together show: weak signals spread over a project, and instruction files read one after the other."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.operators.rules import IMPACT
from siftspark.operators.scan import scan_text
from siftspark.session import cut_lineage

# Files and signals from which weak signals are spread, signals from which one file has too many, and what of it is sure.
SPREAD_FILES, SPREAD_SIGNALS, FILE_SIGNALS = 3, 4, 5
INSTRUCTION_LIKE = ("instruction_override", "system_prompt", "hidden_text")
#: Bytes of text that are joined at a time; a project with more is read in runs that share a file.
RUN_BYTES = 4 << 20


def spread_signals(suppressed: DataFrame, project: str, source: str) -> DataFrame:
    """project, source, line, start, end, excerpt, confidence, files, total, here: one medium finding for each file of a project whose weak signals are spread.

    ``suppressed`` has a row for each suppressed finding. Signals are counted by file and then by project, so a project of any size is two rows of sums.
    """
    weak = suppressed.where(F.col("category").isin(*INSTRUCTION_LIKE))
    by_file = cut_lineage(weak.groupBy(project, source).agg(F.count(F.lit(1)).alias("here"), F.min(F.struct("start", "end", "line", "excerpt")).alias("first")))  # read twice below
    by_project = by_file.groupBy(project).agg(F.count(F.lit(1)).alias("files"), F.sum("here").alias("total"))
    enough = ((F.col("files") >= SPREAD_FILES) & (F.col("total") >= SPREAD_SIGNALS)) | ((F.col("files") == 1) & (F.col("total") >= FILE_SIGNALS))
    sums = by_project.where(enough).withColumn("confidence", F.round(F.least(0.5 + F.col("total") / 20, F.lit(0.85)), 6))
    return by_file.join(sums, project).select(project, source, "first.line", "first.start", "first.end", "first.excerpt", F.lit("instruction_override").alias("category"), F.lit(2).alias("level"), "confidence", "files", "total", "here")


def joined_findings(documents: DataFrame, project: str, source: str, text: str, found: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """project, category, level, confidence, excerpt, sources: findings of a project's instruction files read as one text that none of them shows by itself.

    Files follow by their names, each ended by a blank line. ``found`` (project, category, excerpt) are those of the single files. Runs of about ``run_bytes`` are read as one text; where a
    project has more, the next run begins with the last file of the run before, so nothing that reaches from one file into the next is lost. Projects with one file have none; null texts and sources aren't files.
    """
    w = Window.partitionBy(project).orderBy(source, "__text")
    files = documents.select(project, source, F.col(text).alias("__text")).where(F.col(text).isNotNull() & F.col(source).isNotNull())
    sized = files.withColumn("__run", F.floor((F.sum(F.octet_length("__text").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.octet_length("__text")) / run_bytes))
    ends = sized.withColumn("__next", F.lead("__run").over(w))
    shared = ends.where(F.col("__next") > F.col("__run")).withColumn("__run", F.col("__next")).drop("__next")
    runs = ends.drop("__next").unionByName(shared).groupBy(project, "__run").agg(F.array_sort(F.collect_list(F.struct(F.col(source).alias("source"), F.col("__text").alias("text")))).alias("files")).where(F.size("files") > 1)

    @F.arrow_udf("array<struct<category:string,level:int,confidence:double,excerpt:string,sources:array<string>>>")
    def read(groups: pa.Array) -> pa.Array:
        out = []
        for group in groups.to_pylist():
            text, at, starts = "", 0, []
            parts = []
            for f in group:
                part = f["text"] + ("" if f["text"].endswith("\n") else "\n") + "\n"
                starts.append((at, at + len(part.encode("utf-8", "replace")), f["source"]))
                at = starts[-1][1]
                parts.append(part)
            text = "".join(parts)
            rows = []
            for x in scan_text(text, "aggregate", None):
                touched = [s for a, b, s in starts if x["root_start"] < b and x["root_end"] > a]
                rows.append({"category": x["category"], "level": x["level"], "confidence": x["confidence"], "excerpt": x["excerpt"], "sources": touched})
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("category", pa.string()), ("level", pa.int32()), ("confidence", pa.float64()), ("excerpt", pa.string()), ("sources", pa.list_(pa.string()))])))

    every = runs.select(project, F.explode(read(F.col("files"))).alias("f")).select(project, "f.*").withColumn("__seen", F.trim("excerpt"))
    seen = found.select(project, "category", F.trim("excerpt").alias("__seen")).distinct()
    return every.join(seen, [project, "category", "__seen"], "left_anti").drop("__seen").distinct()


assert set(INSTRUCTION_LIKE) <= IMPACT.keys()
