"""Subject areas of documents by an anchored non-negative factorisation.

The document-term matrix is factored into document weights and term profiles, one profile
for each subject and one for what any text may say. Profiles are anchored: those of the
subjects start from labelled documents, and only on terms that mark a subject there.
Multiplicative updates (of the Kullback-Leibler kind) alternate between both factors and
keep zeros, so a component stays the subject it began as, and its share in a document's
weights is the subject's share in what the document says.

Terms are hashed into a fixed number of columns, so a profile's size doesn't depend on the
data: it is summed up by column blocks in a distributed reduction, made on the driver and
broadcast (12 MB for 10 subjects, 64 MB for the most there may be). Rows never leave the executors.

In each pass over the matrix a bounded number of tasks (a multiple of the cores, not of the data) add up their
rows, and send the blocks of columns they have touched, sparse where they are; so what is shuffled doesn't grow with the data.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from siftspark.session import cut_lineage, spread

#: Columns of the matrix.
COLUMNS = 1 << 18
#: Columns in a block of the reduction, which is also the most reducers there are: COLUMNS / BLOCK.
BLOCK = 1 << 9
#: Tasks of a pass for each core: more partitions are read by one task one after the other.
TASKS = 4
#: The most subjects: profiles are COLUMNS x (subjects + 1) floats in each worker.
MOST_SUBJECTS = 60
#: The anchors are fitted on about so many labelled documents at most, chosen by a hash of their ids.
MOST_LABELLED = 200_000
#: A term marks a subject if so large a part of its occurrences by label, at equal numbers of documents, is there.
MARKS, MAY_MARK = 0.4, 0.2
#: Weight at which a term too rare among the labelled to tell begins in the subjects, if it is met five times at least; the alternations then attribute it.
OPEN = 0.03
#: Share of a document's subject matter from which a subject is assigned: the third asked for, less the error of measuring it on short texts.
LEAST_SHARE = 0.3
#: Least subject matter of a document, in words and as a part of all its words.
LEAST_WORDS, LEAST_PART = 2.0, 0.02
#: Alternations between the factors, and the most updates of the weights in each; they end where no weight changes by more than STILL.
ROUNDS, UPDATES, STILL = 3, 30, 2e-3
#: Occurrences of a term in a text that count in full.
LINEAR = 8
#: Matrix entries in memory at a time.
CHUNK = 200_000

_WORD = re.compile(r"(?<![\w])[^\W\d_]{2,}(?![\w])")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
#: Scripts written without blanks: their terms are pairs of neighbours.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]{2,}")
_FORMAT = frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cf")


@lru_cache(1 << 18)
def _column(word: str) -> int:
    return crc32(word.encode("utf-8", "replace")) % COLUMNS


def terms(text: str | None) -> dict[int, float]:
    """Column and count of each term of ``text``: words of two letters or more, and pairs of neighbours in scripts without blanks.

    Counts beyond ``LINEAR`` grow by their logarithm, so that no single text makes a profile.
    """
    if not text:
        return {}
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    if text.isascii():
        words = Counter(_WORD.findall(text.lower()))
    else:
        text = unicodedata.normalize("NFKC", text).lower()
        signs = set(text)
        if not signs.isdisjoint(_FORMAT):
            text = "".join(c for c in text if c not in _FORMAT)
        pairs: list[str] = []
        if max(signs) >= "\u0e00" and _UNSPACED.search(text):
            runs = _UNSPACED.findall(text)
            pairs = [r[i : i + 2] for r in runs for i in range(len(r) - 1)]
            text = _UNSPACED.sub(" ", text)
        words = Counter(_WORD.findall(text))
        words.update(pairs)
    out: dict[int, float] = {}
    for word, n in words.items():
        column = _column(word)
        out[column] = out.get(column, 0) + (n if n <= LINEAR else LINEAR * (1 + log(n / LINEAR)))
    return out


_ROW = StructType([StructField("columns", ArrayType(IntegerType())), StructField("counts", ArrayType(FloatType()))])


@F.arrow_udf(_ROW)
def _matrix_row(texts: pa.Array) -> pa.Array:
    columns: list[int] = []
    counts: list[float] = []
    ends = [0]
    for value in texts:
        row = terms(value.as_py())
        columns.extend(row)
        counts.extend(row.values())
        ends.append(len(columns))
    offsets = pa.array(ends, pa.int32())
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(offsets, pa.array(columns, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.float32()))],
        fields=[pa.field("columns", pa.list_(pa.int32())), pa.field("counts", pa.list_(pa.float32()))],
    )


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row of each entry, columns, counts), a bounded number of entries at a time."""
    columns, counts = batch.column("columns"), batch.column("counts")
    ends = columns.offsets.to_numpy()
    all_columns, all_counts = columns.values.to_numpy(zero_copy_only=False), counts.values.to_numpy(zero_copy_only=False)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
        last = min(last, batch.num_rows)
        a, b = ends[first], ends[last]
        yield first, last, np.repeat(np.arange(last - first), np.diff(ends[first : last + 1])), all_columns[a:b], all_counts[a:b]
        first = last


def _weights(profiles: np.ndarray, rows: int, row: np.ndarray, columns: np.ndarray, counts: np.ndarray, updates: int = UPDATES) -> tuple[np.ndarray, np.ndarray]:
    """Weights of each row by multiplicative updates until they stand still, and the profile of each entry.

    Terms of no subject say nothing but their number: they are counted once and not in each update.
    """
    k = profiles.shape[1] - 1
    weights = np.full((rows, k + 1), 1.0 / (k + 1), np.float32)
    entry = profiles[columns]
    if not len(columns):
        return weights, entry
    tells = entry[:, :k].any(1)
    plain = np.bincount(row[~tells], counts[~tells] * (entry[~tells, k] > 0), rows).astype(np.float32)
    own, told, given = row[tells], entry[tells], counts[tells]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    present = own[starts] if len(own) else np.zeros(0, int)
    silent = np.ones(rows, bool)
    silent[present] = False
    weights[silent & (plain > 0)] = np.eye(k + 1, dtype=np.float32)[k]
    busy = np.arange(len(present))  # rows that still change
    take, local = np.arange(len(own)), np.repeat(np.arange(len(present)), np.diff(np.r_[starts, len(own)]))
    for _ in range(updates if len(own) else 0):
        rows_now = present[busy]
        w = weights[rows_now]
        e, c = told[take], given[take]
        fitted = np.einsum("ek,ek->e", e, w[local]) + np.float32(1e-20)
        first = np.flatnonzero(np.r_[True, local[1:] != local[:-1]])
        new = w * np.add.reduceat(e * (c / fitted)[:, None], first, axis=0)
        new[:, k] += plain[rows_now]
        new /= np.maximum(new.sum(1, keepdims=True), np.float32(1e-20))
        weights[rows_now] = new
        moving = np.abs(new - w).max(1) > STILL
        if not moving.any():
            break
        if not moving.all():
            kept = moving[local]
            take = take[kept]
            renumber = np.cumsum(moving) - 1
            local = renumber[local[kept]]
            busy = busy[moving]
    return weights, entry


def _summed(matrix: DataFrame, width: int, part: Callable) -> np.ndarray:
    """Sum over all rows of what ``part`` gives for each entry: an array (COLUMNS, width).

    A bounded number of tasks add up their rows and emit the blocks of columns they have touched; blocks are added up by a
    shuffle, and the driver gets one row for each block, however many rows the matrix has.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((COLUMNS, width), np.float64)
        touched = np.zeros(COLUMNS // BLOCK, bool)
        for batch in batches:
            for first, last, row, columns, counts in _chunks(batch):
                values = part(batch, first, last, row, columns, counts)
                for j in range(width):
                    total[:, j] += np.bincount(columns, values[:, j], COLUMNS)
                touched[np.unique(columns // BLOCK)] = True
        blocks = np.flatnonzero(touched)
        for b in blocks:
            sums = total[b * BLOCK : (b + 1) * BLOCK].astype(np.float32)
            places = np.flatnonzero(sums.any(1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([places.tobytes()], pa.binary()), pa.array([sums[places].tobytes()], pa.binary())], names=["block", "places", "sums"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, places, s in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                block = held.setdefault(b, np.zeros((BLOCK, width), np.float64))
                block[np.frombuffer(places.as_buffer(), np.int32)] += np.frombuffer(s.as_buffer(), np.float32).reshape(-1, width)
        for b, block in held.items():
            places = np.flatnonzero(block.any(1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([places.tobytes()], pa.binary()), pa.array([block[places].astype(np.float32).tobytes()], pa.binary())], names=["block", "places", "sums"]
            )

    schema = "block int, places binary, sums binary"
    out = np.zeros((COLUMNS, width), np.float32)
    tasks = TASKS * matrix.sparkSession.sparkContext.defaultParallelism
    for r in matrix.coalesce(tasks).mapInArrow(partial, schema).repartition("block").mapInArrow(add, schema).toLocalIterator():
        out[r.block * BLOCK + np.frombuffer(bytes(r.places), np.int32)] = np.frombuffer(bytes(r.sums), np.float32).reshape(-1, width)
    return out


def _anchored(labelled: np.ndarray, documents: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """First profiles: ``labelled`` has the labelled documents of each term and subject, ``documents`` those of each subject, ``totals`` the occurrences in all texts."""
    k = labelled.shape[1]
    mean = max(float(documents[documents > 0].mean()), 1e-9)
    rate = labelled / np.maximum(documents, 1e-9) + 0.1 / mean
    rate[:, documents == 0] = 0
    part = rate / np.maximum(rate.sum(1, keepdims=True), 1e-20)
    seen, best = labelled.sum(1), part.max(1)
    marking = (best >= MARKS) & (seen >= 1.5)
    open_terms = ~marking & ~((best < MARKS) & (seen >= 8))  # too rare among the labelled to tell
    profiles = np.zeros((len(totals), k + 1), np.float64)
    profiles[:, :k] = np.where(marking[:, None] & (part >= MAY_MARK), part, 0) * totals[:, None]
    profiles[:, :k] += np.where(open_terms[:, None], np.where(totals >= 5, OPEN, OPEN / 30)[:, None] * part, 0) * totals[:, None]
    profiles[:, k] = totals * np.where(marking, 0.02, 1.0)
    return _normalised(profiles)


def _normalised(profiles: np.ndarray) -> np.ndarray:
    return (profiles / np.maximum(profiles.sum(0, keepdims=True), 1e-20)).astype(np.float32)


def subject_mixtures(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = ROUNDS, least: float = 0.01) -> DataFrame:
    """For each document and subject with a share over ``least`` in it: doc_id, subject, share, words.

    ``share`` is the subject's part in the document's subject matter, ``words`` how many of its
    words (counted as in :func:`terms`) that matter makes up. Null, empty and blank texts, and texts without terms, give no
    row. Without usable labels (of subjects in ``subjects``, of documents in ``documents``)
    there is no row. Repeated labels count once; of several subjects of a document each counts
    in part; repeated documents give repeated rows; further columns are ignored.
    """
    spark = documents.sparkSession
    names = sorted(r[0] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().limit(MOST_SUBJECTS + 1).collect())
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    k = len(names)
    schema = "doc_id long, subject string, share double, words double"
    if not k:
        return spark.createDataFrame([], schema)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("subject")).cast("int") - 1
    own = labels.where(F.col("subject").isin(names) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_set(place)).alias("labels"))
    # The bound on labelled documents: a part of them by hash where there are more.
    count = own.count()
    if count > MOST_LABELLED:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * MOST_LABELLED / count))
    rows = spread(documents.select("doc_id", "text")).select("doc_id", _matrix_row(F.col("text")).alias("row")).select("doc_id", "row.columns", "row.counts").where(F.size("columns") > 0)
    matrix = cut_lineage(rows.join(F.broadcast(own), "doc_id", "left"))  # at most about MOST_LABELLED rows

    def by_label(batch, first, last, row, columns, counts):
        given = batch.column("labels").slice(first, last - first).to_pylist()
        share = np.zeros((last - first, k + 1), np.float32)
        for i, own_labels in enumerate(given):
            if own_labels:
                share[i, own_labels] = 1 / len(own_labels)
        values = share[row]
        values[:, k] = counts
        return values

    sums = _summed(matrix.select("columns", "counts", "labels"), k + 1, by_label)
    in_subject = {r[0]: r[1] for r in matrix.where("labels IS NOT NULL").select(F.explode("labels").alias("s"), (1 / F.size("labels")).alias("n")).groupBy("s").agg(F.sum("n")).collect()}
    if not in_subject:
        return spark.createDataFrame([], schema)
    profiles = _anchored(sums[:, :k].astype(np.float64), np.array([in_subject.get(i, 0.0) for i in range(k)]), sums[:, k].astype(np.float64))

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(profiles)

        def attributed(batch, first, last, row, columns, counts, sent=sent):
            weights, entry = _weights(sent.value, last - first, row, columns, counts)
            joint = entry * weights[row]
            return joint * (counts / (joint.sum(1) + np.float32(1e-20)))[:, None]

        profiles = _normalised(_summed(matrix.select("columns", "counts"), k + 1, attributed).astype(np.float64))
        sent.destroy()

    final = spark.sparkContext.broadcast(profiles)

    def mixtures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, row, columns, counts in _chunks(batch):
                weights, _ = _weights(final.value, last - first, row, columns, counts)
                words = np.bincount(row, counts, last - first)
                matter = weights[:, :k].sum(1)
                share = weights[:, :k] / np.maximum(matter, 1e-20)[:, None]
                doc, which = np.nonzero((share > least) & ((matter * words >= LEAST_WORDS) & (matter >= LEAST_PART))[:, None])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(doc + first)),
                        pa.array([names[w] for w in which], pa.string()),
                        pa.array(share[doc, which].astype(np.float64)),
                        pa.array((matter * words)[doc].astype(np.float64)),
                    ],
                    names=["doc_id", "subject", "share", "words"],
                )

    return matrix.select("doc_id", "columns", "counts").mapInArrow(mixtures, schema)


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, subject of each subject that makes up a third of a document's subject matter or more."""
    return subject_mixtures(documents, labels, subjects).where(F.col("share") >= least_share).select("doc_id", "subject").distinct()


def corpus_composition(mixtures: DataFrame) -> DataFrame:
    """Subject matter of the corpus by subject: subject, documents, words, share. ``mixtures`` with ``least`` = 0 have all of it, however thinly it is spread."""
    by = mixtures.groupBy("subject").agg(F.count_if(F.col("share") >= LEAST_SHARE).alias("documents"), F.sum(F.col("share") * F.col("words")).alias("words"))
    whole: Column = F.lit(float(by.agg(F.sum("words")).first()[0] or 1.0))
    return by.withColumn("share", F.col("words") / whole)
