"""Mixing sources to target weights by pivotal dependent rounding.

A source whose share asks for r copies of each of its tokens gives every document
floor(r) copies and one more with probability r - floor(r). Rounding these probabilities
one by one would let the source's tokens drift; here they are rounded in pairs. Of two
fractional documents, tokens are moved from one to the other, in a random direction
chosen so that both expectations stay, until one of them is integral. The source's tokens
stay the same in every step, and the last document left is rounded to the nearer side, so a source misses its
share by half of one document at most.

Pairs are met along a tree: each group of a source's documents is reduced to one
residual, the residuals are grouped and reduced again, until one is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.encode import Vocabulary
from siftspark.session import cut_lineage

#: Documents (or residuals) of a source reduced to one by one task.
GROUP = 10_000
#: A probability this close to 0 or 1 is integral; less than a millionth of a copy.
CLOSE = 1e-9

_SWEPT = "source string, doc_id long, tokens long, whole long, frac double"


def pivot(a_tokens: float, a: float, b_tokens: float, b: float, draw: float) -> tuple[float, float]:
    """Moves tokens between two fractional documents until one is integral; ``draw`` is uniform in [0, 1).

    a_tokens * a + b_tokens * b stays the same, and so do the expectations of a and b.
    """
    up = min((1 - a) * a_tokens, b * b_tokens)  # tokens that can move from b to a
    down = min(a * a_tokens, (1 - b) * b_tokens)  # and from a to b
    moved = up if draw * (up + down) < down else -down
    return a + moved / a_tokens, b - moved / b_tokens


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduces each (source, group) of rows in order to one fractional row at most."""
    held = None  # [source, doc_id, tokens, whole, frac]
    group = None
    out: list[list] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        out.clear()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["source", "doc_id", "tokens", "whole", "frac"])

    def settled(row: list) -> bool:
        if row[4] <= CLOSE or row[4] >= 1 - CLOSE:
            out.append([row[0], row[1], row[2], row[3] + round(row[4]), 0.0])
            return True
        return False

    for b in batches:
        for source, part, doc_id, tokens, whole, frac, draw in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (source, part) != group:
                if held:
                    out.append(held)
                held, group = None, (source, part)
            row = [source, doc_id, tokens, whole, frac]
            if settled(row):
                continue
            if held is None:
                held = row
                continue
            held[4], row[4] = pivot(held[2], held[4], row[2], row[4], draw)
            rest = [r for r in (held, row) if not settled(r)]
            held = rest[0] if rest else None
        if len(out) > 10_000:
            yield batch()
    if held:
        out.append(held)
    yield batch()


def mixture(
    sized: DataFrame,
    targets: DataFrame,
    total_tokens: float | None = None,
    seed: int = 0,
    group: int = GROUP,
) -> DataFrame:
    """Copies of each document in the mixture: source, doc_id, tokens, copies (0 for documents left out).

    ``sized`` has doc_id, source and tokens; ``targets`` source, target_share and
    max_repeats. Without ``total_tokens`` the mixture is as large as it can be with every
    source at its share; with it, a source that can't fill its share at max_repeats
    copies gives all it has. Shares of listed sources without a token fall to the others in
    proportion. Documents of unlisted or null sources aren't in the result; null or zero
    tokens give no copies; a null share counts as 0 and null max_repeats as 1; an empty table
    on either side gives an empty mixture. The same seed gives the same mixture, however
    the rows are spread, and whichever executors are lost.
    """
    listed = targets.where("source IS NOT NULL").groupBy("source").agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most")
    )
    rows = sized.select("doc_id", "source", F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    sources = cut_lineage(
        rows.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("docs")).join(listed, "source")
    )
    # Three numbers for the whole corpus, however many documents or sources there are.
    usable = (F.col("share") > 0) & (F.col("available") > 0) & (F.col("most") > 0)
    weight, largest, docs = sources.agg(
        F.sum(F.when(usable, F.col("share"))),
        F.min(F.when(usable, F.col("most") * F.col("available") / F.col("share"))),
        F.max("docs"),
    ).first()
    total = total_tokens if total_tokens is not None else (largest or 0.0) * (weight or 0.0)
    rate = F.when(usable, F.least(F.lit(float(total)) * F.col("share") / F.lit(weight or 1.0) / F.col("available"), F.col("most").cast("double"))).otherwise(0.0)
    rated = sources.select("source", rate.alias("rate"))
    # A rate a rounding error below a whole number is that number.
    rated = rated.withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < CLOSE, F.round("rate")).otherwise(F.col("rate")))
    start = rows.join(rated, "source").select(
        "source",
        "doc_id",
        "tokens",
        F.when(F.col("tokens") > 0, F.floor("rate")).otherwise(0).cast("long").alias("whole"),
        F.when(F.col("tokens") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0).alias("frac"),
    )
    result, left, most = None, start, docs or 0
    level = 0
    while True:
        spread = max(1, -(-most // group))  # groups of the largest source; smaller ones get fewer rows in each
        draw = lambda salt: F.xxhash64(F.lit(seed * 1000 + level), F.lit(salt), "source", "doc_id")  # noqa: E731, B023
        swept = (
            left.withColumn("part", F.pmod(draw("part"), F.lit(spread)))
            .withColumn("place", draw("place"))
            .repartition("source", "part")
            .sortWithinPartitions("source", "part", "place", "doc_id")
            .select("source", "part", "doc_id", "tokens", "whole", "frac", (F.shiftrightunsigned(draw("draw"), 11) / F.lit(float(2**53))).alias("toss"))
            .mapInArrow(_reduce, _SWEPT)
        )
        swept = cut_lineage(swept)
        done = swept.where("frac = 0")
        result = done if result is None else result.unionByName(done)
        left = swept.where("frac > 0")
        if spread == 1:
            break
        most, level = spread, level + 1
    result = result.unionByName(left.withColumn("whole", F.col("whole") + F.when(F.col("frac") >= 0.5, 1).otherwise(0)))
    return result.select("source", "doc_id", "tokens", F.col("whole").alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What each listed source reached: source, target_share, max_repeats, documents, available, mixed_tokens, most_copies, actual_share, possible_total, total_tokens, binding.

    ``possible_total`` is how large the whole mixture could be if this source alone were the limit; the least of them binds the mixture where no total is asked for:
    ``binding`` names its source in every row, so that one small source with a large share doesn't shrink the corpus unseen. It is null where no source has a token.
    """
    reached = mixed.groupBy("source").agg(
        F.count_if(F.col("copies") > 0).alias("documents"),
        F.sum("tokens").alias("available"),
        F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"),
        F.max("copies").alias("most_copies"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = targets.join(reached, "source", "left").select("source", "target_share", "max_repeats", *map(zero, ("documents", "available", "mixed_tokens", "most_copies")))
    # Shares of listed sources without a token fall to the others.
    counts = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.coalesce("max_repeats", F.lit(1)) > 0)
    weight = joined.agg(F.sum(F.when(counts, F.col("target_share")))).first()[0] or 0.0
    possible = F.when(counts, F.coalesce("max_repeats", F.lit(1)) * F.col("available") / F.col("target_share") * F.lit(float(weight)))
    rated = joined.withColumn("possible_total", possible)
    whole, binding = rated.agg(F.sum("mixed_tokens"), F.min_by("source", F.struct(F.coalesce("possible_total", F.lit(float("inf"))), "source"))).first() if weight else (0, None)
    whole = whole or 0
    return rated.withColumn("actual_share", F.col("mixed_tokens") / F.lit(float(whole)) if whole else F.lit(0.0)).withColumn("total_tokens", F.lit(int(whole)).cast("long")).withColumn("binding", F.lit(binding).cast("string"))


def sized_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source and tokens of each document, written once as every later step reads it."""
    count = Vocabulary(documents.sparkSession, vocabulary).count(F.col("text"))
    return cut_lineage(documents.select("doc_id", "source", count.alias("tokens")))
