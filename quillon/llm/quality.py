"""Quality by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics.  Class means and covariances come
from sums over all labelled training rows (one aggregation with map-side combine; a fixed
number of sums, whatever the input).  Covariances are shrunk towards the pooled one and
towards its diagonal; their Cholesky factors are computed once and cached in the model.  A
text's score is the logistic of the calibrated difference of Mahalanobis log-densities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out
from .textkit import Words, blocks

FEATURES = (
    "words", "word_length", "long_words", "capitals", "digits", "marks", "symbols", "bars", "spaces",
    "distinct_words", "stops", "repeated_lines",
)
#: shares of the pooled covariance and of the diagonal in each class covariance
POOLED, DIAGONAL, FLOOR = 0.1, 0.05, 1e-4
#: log-density differences are counted in bins of this width up to this size to calibrate them
BIN, BIN_LIMIT = 0.5, 60.0


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[[ord(c) for c in chars]] = 1
    return t


_KINDS = np.stack([
    _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table("!?"), _table("#$%&*@^~<>{}=+\\"),
    _table("|"), _table(" \t\r\n"), _table(".,;:"),
])


def statistics(group: list[bytes]) -> np.ndarray:
    """Rows of transformed statistics; of an empty text all but the logarithms are at their zero."""
    w = Words(group)
    raw = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
    chars = np.maximum(1, np.diff(w.text_at) - 1)
    count = w.counts()
    least = np.maximum(1, count)
    share = []
    for t in _KINDS:
        c = np.concatenate(([0], np.cumsum(t[raw])))
        share.append((c[w.text_at[1:] - 1] - c[w.text_at[:-1]]) / chars)
    size = w.end - w.start
    sums = np.concatenate(([0], np.cumsum(size)))
    long_sums = np.concatenate(([0], np.cumsum(size > 12)))
    by = lambda s: (s[w.first[1:]] - s[w.first[:-1]]) / least
    distinct, lines = np.ones(len(group)), np.zeros(len(group))
    for i, t in enumerate(group):
        h = w.hash[w.first[i] : w.first[i + 1]]
        if len(h):
            distinct[i] = len(np.unique(h)) / len(h)
        parts = [p for p in t.split(b"\n") if p.strip()]
        if parts:
            lines[i] = 1 - len(set(parts)) / len(parts)
    root = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    return np.column_stack((
        np.log1p(count), np.log1p(by(sums)), root(by(long_sums)), root(share[0]), root(share[1]), root(share[2]),
        root(share[3]), root(share[4]), root(share[5]), np.log(distinct) / np.log1p(least), root(share[6]), root(lines),
    ))


def _measurer(batches):
    for batch in batches:
        rows = [statistics(g) for _, g in blocks(batch.column(1).to_pylist())]
        x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["id", "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of each text, in the order of ``FEATURES``."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_measurer, "id long, x array<double>")


@dataclass
class Discriminant:
    """Means, cached inverse Cholesky factors and log constants of both classes, and the calibration."""

    means: np.ndarray
    whiten: np.ndarray
    constant: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density (with prior) of class 1 less that of class 0."""
        d = [self.constant[k] - 0.5 * (((x - self.means[k]) @ self.whiten[k].T) ** 2).sum(1) for k in (0, 1)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -500, 500)))


def fit(moments: list, d: int = len(FEATURES)) -> Discriminant | None:
    """From rows (y, n, s, ss): counts, sums and upper sums of products by class; None unless both occur."""
    by = {int(r.y): r for r in moments if r.y in (0, 1) and r.n >= 2}
    if len(by) < 2:
        return None
    n, mean, cov = {}, {}, {}
    for k, r in by.items():
        n[k], mean[k] = float(r.n), np.array(r.s) / r.n
        second = np.zeros((d, d))
        second[np.triu_indices(d)] = np.array(r.ss) / r.n
        second += np.triu(second, 1).T
        cov[k] = second - np.outer(mean[k], mean[k])
    total = n[0] + n[1]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / total
    whiten, constant = [], []
    for k in (0, 1):
        c = (1 - POOLED) * cov[k] + POOLED * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + FLOOR * np.eye(d)
        factor = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(factor))
        constant.append(np.log(n[k] / total) - np.log(np.diag(factor)).sum())
    return Discriminant(np.stack([mean[0], mean[1]]), np.stack(whiten), np.array(constant))


def calibrate(model: Discriminant, bins: list) -> None:
    """Logistic slope and offset from rows (bin, n, positive): at most 2 * BIN_LIMIT / BIN + 1 of them."""
    z = np.array([r.bin * BIN for r in bins])
    n, y = np.array([float(r.n) for r in bins]), np.array([float(r.positive) for r in bins])
    w, x = np.array([0.0, 1.0]), np.column_stack((np.ones(len(z)), z))
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - n * p))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    if w[1] > 0:
        model.offset, model.slope = float(w[0]), float(w[1])


def _scorer(model: Discriminant | None, raw: bool):
    def score(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
            s = np.full(len(x), 0.5) if model is None else model.difference(x) if raw else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s)], ["id", "held_out", "score"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``.

    Training rows are those whose crc32 of the id modulo 5 is not 0 and whose label
    ``quality`` is 0 or 1.  Null texts count as empty and are scored like any other;
    repeated rows are scored alike; unless both classes have two labelled rows every score
    is 0.5.  Other columns are not read.
    """
    sc = Scratch(docs.sparkSession, "quality")
    x = sc.keep(document_statistics(docs, id_col, text_col).withColumn("held_out", held_out("id", 5, 0)))
    truth = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    d = len(FEATURES)
    f = [F.col("x")[i] for i in range(d)]
    train = x.where("not held_out").join(truth, "id")
    moments = train.groupBy("y").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(a) for a in f]).alias("s"),
        F.array(*[F.sum(f[i] * f[j]) for i in range(d) for j in range(i, d)]).alias("ss"),
    )
    model = fit(moments.collect())
    if model:
        z = train.select("id", "x", F.lit(False).alias("held_out")).mapInArrow(_scorer(model, True), "id long, held_out boolean, score double")
        # the id joins a row's difference to its labels again; repeated ids weigh by their rows
        z = z.select("id", F.round(F.least(F.greatest(F.col("score"), F.lit(-BIN_LIMIT)), F.lit(BIN_LIMIT)) / BIN).cast("int").alias("bin")).distinct()
        bins = z.join(truth, "id").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("positive"))
        calibrate(model, bins.collect())
    out = x.mapInArrow(_scorer(model, False), "id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from ``labels.quality`` of the training fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_scores(docs, labels).withColumnRenamed("id", "doc_id")
