"""A quality classifier by regularised quadratic discriminant analysis over document statistics.

Each text gives a fixed list of statistics, made roughly normal by logarithms and log-odds. Each class has a mean and a
covariance, shrunk towards the pooled diagonal; the score is the difference of the two Mahalanobis log-densities and the
log prior, through the logistic function. Cholesky factors are computed once and travel with the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drop, map_text, shared_folder, structs, table_batch, tidy, written
from .language_id import held_out

#: Weights of the pooled diagonal in each class's covariance, and of a unit ridge after standardising.
SHRINK, RIDGE = 0.1, 0.02
#: The least variance a statistic is taken to have: one that is the same in all labelled rows must not be divided by rounding noise.
FLAT = 1e-6
NAMES = ("length", "words", "word_length", "word_spread", "distinct", "upper", "digits", "symbols", "stops", "exclaims", "spaces", "lines", "same_lines", "short_words", "entropy", "bars")
KIND = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
SLICE = 1 << 20


def odds(part: float, whole: float) -> float:
    r = part / whole if whole else 0.0
    return math.log((r + 0.002) / (1.002 - r))


def statistics(text: str) -> list[float]:
    """The statistics of NAMES; an empty text has all of them too. Works by slices, which change no value."""
    hist = np.zeros(256, np.int64)
    n_words = total = square = short = 0
    distinct: set[str] = set()
    lines: set[str] = set()
    n_lines = 0
    word = line = ""  # what the slice before left unfinished
    for k in range(0, len(text), SLICE):
        part = text[k : k + SLICE]
        hist += np.bincount(np.frombuffer(part.encode("utf-8", "replace"), np.uint8), minlength=256)
        last = k + SLICE >= len(text)
        words = (word + part).split()
        word = "" if last or part[-1].isspace() else words.pop()
        n_words += len(words)
        distinct.update(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        total += int(size.sum())
        square += int((size * size).sum())
        short += int((size <= 3).sum())
        own = (line + part).split("\n")
        line = "" if last else own.pop()
        own = [x for x in own if x]
        n_lines += len(own)
        lines.update(own)
    n = int(hist.sum())
    upper, lower, digits, high = int(hist[65:91].sum()), int(hist[97:123].sum()), int(hist[48:58].sum()), int(hist[128:].sum())
    spaces, stops = int(hist[[9, 10, 13, 32]].sum()), int(hist[[44, 46]].sum())
    symbols = n - upper - lower - digits - high - spaces - stops
    mean = total / n_words if n_words else 0.0
    p = hist[hist > 0] / max(n, 1)
    return [
        math.log1p(n), math.log1p(n_words), math.log1p(mean), math.log1p(max(0.0, square / n_words - mean * mean) if n_words else 0.0),
        odds(len(distinct), n_words) + 0.35 * math.log1p(n_words), odds(upper, upper + lower), odds(digits, n), odds(symbols, n), odds(stops, n), odds(int(hist[33]), n),
        odds(spaces, n), math.log1p(n / (n_lines + 1)), odds(n_lines - len(lines), n_lines), odds(short, n_words), float(-(p * np.log2(p)).sum()), odds(int(hist[124]), n),
    ]


def statistics_of(text: Column) -> Column:
    """array<double> of a text column; null as empty."""
    return map_text(lambda texts: pa.array([statistics(t or "") for t in texts], pa.list_(pa.float64())), T.ArrayType(T.DoubleType()), text)


@dataclass(frozen=True)
class Discriminant:
    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # class, statistic
    factors: np.ndarray  # class, inverse of the Cholesky factor
    offsets: np.ndarray  # class, log prior less half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        logs = [self.offsets[c] - 0.5 * (((z - self.means[c]) @ self.factors[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -36, 36)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], dims: int) -> Discriminant | None:
    """moments: per class the count, the sum and the sum of outer products. None unless both classes have rows."""
    if any(moments.get(c, (0,))[0] < 1 for c in (0, 1)):
        return None
    n = sum(m[0] for m in moments.values())
    center = sum(m[1] for m in moments.values()) / n
    scale = np.sqrt(np.maximum(np.diag(sum(m[2] for m in moments.values())) / n - center**2, FLAT))
    means, covs = [], []
    for c in (0, 1):
        k, s, q = moments[c]
        mu = s / k
        means.append((mu - center) / scale)
        covs.append((q / k - np.outer(mu, mu)) / np.outer(scale, scale))
    pooled = sum(moments[c][0] / n * np.diag(covs[c]) for c in (0, 1))
    factors, offsets = [], []
    for c in (0, 1):
        cov = (1 - SHRINK) * covs[c] + SHRINK * np.diag(pooled) + RIDGE * np.eye(dims)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        offsets.append(math.log(moments[c][0] / n) - float(np.log(np.diag(low)).sum()))
    return Discriminant(center, scale, np.stack(means), np.stack(factors), np.asarray(offsets))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Discriminant | None:
    """Fit on every labelled row that is not held out. Statistics, not texts, meet the labels; each task sends one row of
    moments per class. Labels other than 0 and 1 are left out; an id that is labelled twice counts as its smaller label."""
    bounded_batches(docs.sparkSession)
    dims = len(NAMES)
    wide = 1 + dims + dims * dims
    kind = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("m", T.ArrayType(T.DoubleType()))])
    own = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").cast("int").alias("_y"))
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("_id"), statistics_of(F.col(text_col)).alias("_x")).join(own, "_id").select("_y", "_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            y = np.asarray(batch.column(0).to_pylist(), np.int64)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for c in np.unique(y).tolist():
                own = x[y == c]
                sums[c] = sums.get(c, np.zeros(wide)) + np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        if sums:
            yield table_batch(kind, y=list(sums), m=[v.tolist() for v in sums.values()])

    # written, so that one Python worker at a time serves a task
    folder = shared_folder(docs.sparkSession, "statistics")
    total = written(rows, folder).mapInArrow(tidy(run), kind).select("y", F.posexplode("m").alias("k", "v")).groupBy("y", "k").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in total.collect():
        out.setdefault(r["y"], np.zeros(wide))[r["k"]] = r["v"]
    drop(folder)
    return fit({c: (v[0], v[1 : dims + 1], v[dims + 1 :].reshape(dims, dims)) for c, v in out.items()}, dims)


def quality(text: Column, model: Discriminant | None) -> Column:
    """struct<score, predicted>; null texts count as empty. Without a model every score is 0.5."""

    def run(texts: list):
        if not texts or model is None:
            s = np.full(len(texts), 0.5)
        else:
            s = model.score(np.asarray([statistics(t or "") for t in texts]))
        return structs(KIND, score=s.tolist(), predicted=(s >= 0.5).astype(int).tolist())

    return map_text(run, KIND, text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn, then score all rows: id, held_out, score, predicted. Repeated rows stay, extra columns are dropped, empty tables
    give empty results."""
    model = learn(docs, labels, id_col, text_col)
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), quality(F.col(text_col), model).alias("_r")).select(id_col, "held_out", "_r.*")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the classifier takes for label 1. Columns stay as they are, whatever their names.

    Null texts are judged as empty ones. If nothing could be learned (no labelled rows of both classes) every row stays. Repeated
    rows are judged alike and stay; an empty table gives an empty one.
    """
    model = learn(docs, labels, id_col, text_col)
    judged = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_d"), quality(F.col(text_col), model).alias("_r"))
    return judged.where(F.col("_r.predicted") == 1).select("_d.*")
