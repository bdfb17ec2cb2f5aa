"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Model: P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for all thresholds and
thresholds in ascending order; the score is the expected grade.

Grades: the labels say toxic or not. A toxic labelled document is grade 2 (severe) if at least
``SEVERE`` percent of its words carry a feature of the toxic lexicon, else grade 1 (mild); the lexicon is
the set of selected features that are ``LEXICON_RATIO`` times as frequent in toxic labelled documents.

Features: presence of whole words and of word beginnings of 5 to 8 bytes (lower-cased, letters only).
The ``FEATURES`` with the largest two-sample z are kept.

Fitting uses a bounded sample: about ``SAMPLE`` labelled documents of each class at most. Labels are drawn by row,
then the documents' rows with a drawn label by row again, each at a rate that follows from the class's number of
rows, so neither a label nor an id that is repeated very often makes the sample larger. Scoring reads every whole text.

Defined cases: null text has no features and gets the score of an empty text; labels that are null
or have no document are ignored; repeated labels and rows count each; without labelled documents of
both classes every score is 0; empty documents give an empty result; only ``doc_id`` and ``text``
of the documents are read, other columns pass through ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise
from .common import unit_draw
from .mixing import numbered

SAMPLE = 4000
FEATURES = 1500
LEAST_DOCS = 5
PREFIXES = (5, 6, 7, 8)
SEVERE = 1.0
LEXICON_RATIO = 20.0
RIDGE = 2e-4
ROUNDS = 400

CACHED = 200_000  #: words whose features a task remembers

_LETTERS = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))  #: what is no ASCII letter becomes a space


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def features_of(word: bytes) -> list[bytes]:
    """The word itself, marked as whole, and its beginnings."""
    return [word + b"$", *[word[:n] for n in PREFIXES if len(word) >= n]]


class Ordinal:
    """Weights by feature and ascending thresholds."""

    def __init__(self, weights: dict[bytes, float], thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds
        self.seen: dict[bytes, tuple[bytes, ...]] = {}

    def severity(self, text: str | None) -> tuple[float, float]:
        """(expected grade, probability of grade 1 or more); the expected grade is the sum of P(grade > k)."""
        if not len(self.thresholds):
            return 0.0, 0.0
        seen, found = self.seen, set()
        if len(seen) > CACHED:
            seen.clear()
        for word in set(words_of(text)):
            known = seen.get(word)
            if known is None:
                known = seen[word] = tuple(f for f in features_of(word) if f in self.weights)
            if known:
                found.update(known)
        above = 1 / (1 + np.exp(self.thresholds - sum(map(self.weights.get, sorted(found)))))
        return float(above.sum()), float(above[0])


def fit(x: np.ndarray, grade: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the cumulative-link likelihood; the gaps between thresholds are kept positive by an exponential."""
    k = int(grade.max())
    share = np.array([(grade > j).mean() for j in range(k)])
    start = np.log((1 - share) / share)
    theta = np.concatenate([np.zeros(x.shape[1]), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    step, first, second = 0.05, np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -35, 35)))
    for t in range(1, rounds + 1):
        w, gaps = theta[: x.shape[1]], np.exp(theta[x.shape[1] + 1 :])
        cut = theta[x.shape[1]] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = (x @ w.astype(np.float32)).astype(np.float64)
        upper = np.where(grade < k, cut[np.minimum(grade, k - 1)], np.inf) - score
        lower = np.where(grade > 0, cut[np.maximum(grade - 1, 0)], -np.inf) - score
        hi, lo = np.where(np.isinf(upper), 1.0, sigmoid(upper)), np.where(np.isinf(lower), 0.0, sigmoid(lower))
        mass = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        to_cut = np.array([(np.where(grade == j, -dhi, 0) + np.where(grade == j + 1, dlo, 0)).mean() for j in range(k)])
        grad = np.concatenate([x.T @ ((dhi - dlo) / len(grade)).astype(np.float32) + ridge * w, [to_cut.sum()], [to_cut[j:].sum() * gaps[j - 1] for j in range(1, k)]])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return theta[: x.shape[1]], theta[x.shape[1]] + np.concatenate([[0.0], np.cumsum(np.exp(theta[x.shape[1] + 1 :]))])


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """``toxic, text`` of about ``bound`` rows per class at most; the labels that are drawn are bounded too, so they are broadcast.

    Draws depend on ids, verdicts and a row's number among equal rows, not on where rows lie.
    """
    graded = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", (F.col("toxic") > 0).alias("toxic")).distinct()

    def rate(rows: DataFrame) -> Column:
        n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        return F.when(F.col("toxic"), bound / max(n.get(True, 1), 1)).otherwise(bound / max(n.get(False, 1), 1))

    drawn = materialise(graded.filter(unit_draw(F.concat_ws("|", "doc_id", "toxic"), "toxicity label") < rate(graded)))
    rows = numbered(docs.select("doc_id", "text", F.lit(None).cast("string").alias("source")).join(F.broadcast(drawn), "doc_id"))
    by_row = rate(docs.select("doc_id").join(F.broadcast(drawn), "doc_id"))
    return rows.filter(unit_draw(F.col("_mix_seed"), "toxicity") < by_row).select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame) -> Ordinal:
    sample = labelled_sample(docs, labels)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(1)]
            lists = [sorted({f for x in set(w) for f in features_of(x)}) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, type=pa.list_(pa.binary())), batch.column(1)], names=["toxic", "found", "text"])

    rows = materialise(sample.mapInArrow(extract, "toxic boolean, found array<binary>, text string"))
    size = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = size.get(True, 0), size.get(False, 0)
    if not n1 or not n0:
        return Ordinal({}, np.zeros(0))
    p1, p0, p = F.col("t") / n1, F.col("c") / n0, (F.col("t") + F.col("c")) / (n1 + n0)
    z = F.abs(p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    best = (
        rows.select("toxic", F.explode("found").alias("f")).groupBy("f")
        .agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))
        .filter(F.col("t") + F.col("c") >= min(LEAST_DOCS, max(n1 // 4, 1)))
        .withColumn("z", z).orderBy(F.col("z").desc(), "f").limit(FEATURES).collect()
    )
    number = {bytes(r.f): i for i, r in enumerate(best)}
    lexicon = {bytes(r.f) for r in best if (r.t / n1) > LEXICON_RATIO * (r.c + 0.5) / n0}
    shared = rows.sparkSession.sparkContext.broadcast((number, lexicon))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, lexicon = shared.value
        for batch in batches:
            grade, ids = [], []
            for toxic, found, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                hits = sum(any(f in lexicon for f in features_of(w)) for w in words)
                grade.append((2 if 100 * hits >= SEVERE * len(words) and hits else 1) if toxic else 0)
                ids.append([number[f] for f in found if f in number])
            yield pa.RecordBatch.from_arrays([pa.array(grade, type=pa.int32()), pa.array(ids, type=pa.list_(pa.int32()))], names=["grade", "ids"])

    held = rows.mapInArrow(encode, "grade int, ids array<int>").collect()  # about 2 x SAMPLE rows of at most FEATURES numbers
    held.sort(key=lambda r: (r.grade, r.ids))
    grade = np.array([r.grade for r in held])
    grade = np.searchsorted(np.unique(grade), grade)  # without severe documents there is one threshold
    x = np.zeros((len(held), len(number)), dtype=np.float32)
    for i, r in enumerate(held):
        x[i, r.ids] = 1
    weights, thresholds = fit(x, grade)
    return Ordinal({f: float(weights[i]) for f, i in number.items()}, thresholds)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``docs`` with ``severity`` (expected grade) and ``p_toxic``; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("severity", "p_toxic")
    at = docs.columns.index("text")
    schema = docs.select("*", F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [shared.value.severity(t.as_py()) for t in batch.column(at)]
            new = [pa.array([b[i] for b in both], type=pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "severity", "p_toxic"])

    return docs.mapInArrow(add, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", "severity", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))
