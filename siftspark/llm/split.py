"""Splitting of oversized texts at natural boundaries, all in Spark SQL expressions.

One regular expression with bounded quantifiers consumes the text piece by piece. Its
alternatives are ordered by boundary strength; each takes as much as the limit lets it
up to its boundary, in the upper half of the limit first, and only then in the lower.
The last alternatives cut between characters. Lookback by the summed lengths of the
pieces before gives the overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries from strong to weak, as lookbehinds at the end of a piece. Spans are bounded, as Java's lookbehind wants.
BOUNDARIES = (
    r"(?<=\n[ \t\r]{0,8}\n)(?![ \t\r]{0,8}\n)",  # blank line
    r"(?<=\n)",  # line
    r"(?<=[.!?…۔।][\"'”’»)\]]{0,3}\s)(?!\s)|(?<=[。！？．]|[。！？][」』”])(?![」』”])",  # sentence
    r"(?<=[;:,–—]\s)(?!\s)|(?<=[，、；：])",  # clause
    r"(?<=\s)(?!\s)|(?<=\u200B)",  # word
    r"(?<=[/\\|\-_=&?,;:.)\]}>])(?![/\\|\-_=&?,;:.)\]}>])",  # sign inside a run without blanks
)
#: Not between these: what belongs to the character before, or is joined to it.
INSIDE = r"(?![\p{M}\u200D\uFE0E\uFE0F\x{1F3FB}-\x{1F3FF}\x{E0020}-\x{E007F}]|(?<=\r)\n)(?<!\u200D)(?!(?<=[\x{1F1E6}-\x{1F1FF}])[\x{1F1E6}-\x{1F1FF}](?<=(?<![\x{1F1E6}-\x{1F1FF}])[\x{1F1E6}-\x{1F1FF}]{2}))"


def _ways(limit: Column) -> list:
    """The pattern of one piece of at most ``limit`` characters, as parts to concatenate."""
    half = F.greatest(F.lit(1), F.floor(limit / 2)).cast("string")
    most = limit.cast("string")
    parts: list[Column] = [F.lit(".{1,"), most, F.lit(r"}\z|")]  # the rest, where it fits
    for low in (half, F.lit("1")):
        for boundary in BOUNDARIES:
            parts += [F.lit(".{"), low, F.lit(","), most, F.lit("}(?:" + boundary + ")" + INSIDE + "|")]
    parts += [F.lit(".{1,"), most, F.lit("}" + INSIDE + "|.{1,"), most, F.lit("}")]
    return parts


def split_items(
    items: DataFrame,
    text: str,
    limit: Column,
    overlap: Column,
) -> DataFrame:
    """Rows of ``items``, one for each piece: all columns but ``text``, and piece_no, n_pieces, piece_from, new_from, piece_to, piece.

    ``limit`` is the most characters (code points) of a piece, ``overlap`` the characters a
    piece repeats of the text before it. Pieces are text[piece_from, piece_to), offsets from
    0; new_from is where a piece's own part begins, and the own parts together are the text.
    Own parts end at natural boundaries where the limit leaves any, else between characters,
    and inside a combined character only if it is longer than the limit.

    Texts within the limit are one piece without overlap. A null text or limit gives no
    row, an empty text one empty piece; a limit under 1 counts as 1; a null or negative
    overlap counts as 0, and one that leaves no room is cut to limit - 1. Equal rows give
    equal pieces each.
    """
    names = ("piece_no", "n_pieces", "piece_from", "new_from", "piece_to", "piece")
    kept = [c for c in items.columns if c not in (*names, text)]
    most = F.greatest(limit.cast("int"), F.lit(1))
    shared = F.least(F.greatest(F.coalesce(overlap.cast("int"), F.lit(0)), F.lit(0)), most - 1)
    sized = items.select(*kept, F.col(text).alias("__text"), most.alias("__most"), shared.alias("__shared"), limit.alias("__limit")).where(
        F.col("__text").isNotNull() & F.col("__limit").isNotNull()
    )
    # The first piece has the whole limit, the others what the overlap leaves.
    first, later = _ways(F.col("__most")), _ways(F.col("__most") - F.col("__shared"))
    pattern = F.concat(F.lit(r"(?s)\A(?:"), *first, F.lit(r")|(?!\A)(?:"), *later, F.lit(")"))
    fits = F.char_length("__text") <= F.col("__most")
    own = F.when(fits, F.array("__text")).otherwise(F.regexp_extract_all("__text", pattern, F.lit(0)))
    cut = sized.withColumn("__own", own)
    lengths = cut.select(*kept, "__own", "__shared", F.transform("__own", F.char_length).alias("__lengths"))
    placed = _prefix_sums(lengths, "__lengths", "__starts")
    # Each own part is at least a character, so the overlap lies in as many parts before it; of each, its end is enough.
    before = lambda i: F.right(
        F.array_join(F.transform(F.slice("__own", F.greatest(i - F.col("__shared"), F.lit(0)) + 1, F.least(i, F.col("__shared"))), lambda q: F.right(q, F.col("__shared"))), ""),
        F.col("__shared"),
    )
    pieces = F.transform(
        "__own",
        lambda own, i: F.struct(
            F.get("__starts", i).alias("new_from"),
            F.get("__lengths", i).alias("own"),
            F.least(F.get("__starts", i), F.col("__shared")).alias("shared"),
            F.concat(before(i), own).alias("piece"),
        ),
    )
    exploded = placed.select(*kept, F.size("__own").alias("n_pieces"), F.posexplode(pieces).alias("__no", "__piece"))
    return exploded.select(
        *kept,
        (F.col("__no") + 1).alias("piece_no"),
        "n_pieces",
        (F.col("__piece.new_from") - F.col("__piece.shared")).alias("piece_from"),
        F.col("__piece.new_from").alias("new_from"),
        (F.col("__piece.new_from") + F.col("__piece.own")).alias("piece_to"),
        F.col("__piece.piece").alias("piece"),
    )


def _prefix_sums(rows: DataFrame, lengths: str, out: str, block: int = 256) -> DataFrame:
    """``rows`` with ``out``: for each element of ``lengths`` the sum of those before it, block by block to stay near linear."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / block).cast("int") - 1, F.lit(0))),
        lambda b: F.slice(lengths, b * block + 1, block),
    )
    rows = rows.withColumn("__blocks", blocks).withColumn("__sums", F.transform("__blocks", total))
    inside = F.transform(
        "__blocks",
        lambda of, b: F.transform(of, lambda _, j: total(F.slice("__sums", 1, b)) + total(F.slice(of, 1, j))),
    )
    return rows.withColumn(out, F.flatten(inside)).drop("__blocks", "__sums")


#: Tokens a text costs besides its characters.
EXTRA_TOKENS = 2


def context_pieces(items: DataFrame, models: DataFrame) -> DataFrame:
    """Pieces of the context documents under the limits of each request's model.

    Rows sent twice count once. Items whose model isn't in ``models`` (or has no limit) give no piece.
    """
    wanted = items.select("request_id", "doc_no", "model_id", "model_version", "text").dropDuplicates(["request_id", "doc_no"])
    limits = models.select("model_id", "model_version", "max_tokens", "overlap_tokens").dropDuplicates(["model_id", "model_version"])
    sized = wanted.join(limits, ["model_id", "model_version"])
    return split_items(sized, "text", F.col("max_tokens") - EXTRA_TOKENS, F.col("overlap_tokens"))
