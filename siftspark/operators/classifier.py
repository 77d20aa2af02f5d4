"""A trained classifier of texts: logistic regression on hashed character n-grams, fitted with Spark ML on a bounded sample, applied to all rows."""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.operators import text as T
from siftspark.session import cut_lineage

#: Columns of the features, and the lengths of their n-grams.
COLUMNS, GRAMS = 1 << 16, (2, 3, 4)
#: The classifier is fitted on about so many labelled rows at most, chosen by a hash of their keys.
MOST_LABELLED = 20_000
#: From this lexical score on the trained classifier is asked.
GATE = 0.2


def features(text: str | None, columns: int = COLUMNS) -> dict[int, float]:
    """Damped counts of a text's hashed character n-grams, of length 1; none for null and empty texts."""
    low = " ".join((text or "").lower().split())
    n = Counter(crc32(low[i : i + k].encode("utf-8", "replace")) % columns for k in GRAMS for i in range(len(low) - k + 1))
    size = math.sqrt(sum((1 + math.log(c)) ** 2 for c in n.values())) or 1.0
    return {i: (1 + math.log(c)) / size for i, c in n.items()}


@dataclass(frozen=True)
class Model:
    """Weights by column. As JSON: {"columns", "bias", "weights"}."""

    columns: int
    bias: float
    weights: dict[int, float]

    def score(self, text: str | None) -> float:
        at = self.bias + sum(self.weights.get(i, 0.0) * v for i, v in features(text, self.columns).items())
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, at))))

    def scores(self, texts: Sequence[str]) -> list[float]:
        return [self.score(t) for t in texts]

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "bias": self.bias, "weights": {str(k): v for k, v in sorted(self.weights.items())}})

    def sha256(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()


def load(text: str) -> Model:
    """The model of :meth:`Model.to_json`'s text; anything else is an error."""
    d = json.loads(text)
    if not (isinstance(d, dict) and isinstance(d.get("columns"), int) and d["columns"] > 0 and isinstance(d.get("weights"), dict)):
        raise ValueError("no model")
    return Model(d["columns"], float(d["bias"]), {int(k): float(v) for k, v in d["weights"].items()})


def fit(rows: DataFrame, key: str, text: str, label: str, most: int = MOST_LABELLED) -> Model:
    """The model fitted on rows with a label of 0 or 1 and a text; at most about ``most`` of them, by a hash of their key. The weights come to the driver: :data:`COLUMNS` numbers."""
    usable = rows.select(key, text, F.col(label).cast("double").alias("label")).where(F.col(text).isNotNull() & F.col("label").isin(0.0, 1.0))
    n = usable.count()
    if n > most:
        usable = usable.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * most / n))
    vector = F.udf(lambda t: SparseVector(COLUMNS, features(t)), VectorUDT())  # of the bounded sample only
    sample = cut_lineage(usable.select("label", vector(F.col(text)).alias("features")))
    if sample.select("label").distinct().count() < 2:
        raise ValueError("both labels are needed")
    fitted = LogisticRegression(maxIter=30, regParam=1e-4).fit(sample)
    return Model(COLUMNS, float(fitted.intercept), {int(i): float(w) for i, w in enumerate(fitted.coefficients.toArray()) if w})


def scored(model: Model, text: Column) -> Column:
    """The model's score of each text; null for null."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else model.score(t) for t in texts.to_pylist()], pa.float64())

    return run(text)


def gated_scores(rows: DataFrame, key: str, text: str, model: Model, least: float = GATE) -> DataFrame:
    """key, score, asked: the lexical score, and from ``least`` on the model's. The rows are split by a filter and joined again by a union, as a function within CASE would be run for all of them."""
    cheap = rows.select(key, text, T.lexical_column(F.col(text)).alias("score"))
    low = F.coalesce(F.col("score"), F.lit(0.0)) < least
    return cheap.where(low).select(key, "score", F.lit(False).alias("asked")).unionByName(cheap.where(~low).select(key, scored(model, F.col(text)).alias("score"), F.lit(True).alias("asked")))
