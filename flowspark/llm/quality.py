"""Quality scores by regularised quadratic discriminant analysis over document statistics.

Every whole text becomes a short vector of statistics, each transformed towards a bell shape
(logarithms of counts, log-odds of shares). For each label the mean and the covariance of the
vectors are estimated from all labelled rows, as sums that Spark merges; the covariance is shrunk
towards the pooled one and towards its diagonal. The score is the logistic of the difference of the
two log densities, from Mahalanobis distances by cached Cholesky factors, plus the log prior odds.

Null text counts as empty; an empty text has statistics like any other. A row with a null
``doc_id`` is scored, not learned from, and not held out. Labels without a document, or null, are
not used; repeated rows and labels count as often as they occur. With labels of one kind only the
score is that label, without any it is 0.5. An empty table gives an empty table, and further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = [
    "word_length", "letters", "capitals", "digits", "marks", "stops", "symbols", "lines", "bars", "distinct_words", "same_next",
    "distinct_pairs", "distinct_lines", "line_words",
]
KINDS = ["other", "lower", "upper", "digit", "stop", "mark", "symbol", "space", "line", "bar", "wide"]


def byte_kinds() -> np.ndarray:
    out = np.zeros(256, np.int64)

    def put(kind: str, chars: bytes | range) -> None:
        out[list(chars)] = KINDS.index(kind)

    put("symbol", range(33, 127))
    put("lower", range(97, 123))
    put("upper", range(65, 91))
    put("digit", range(48, 58))
    put("stop", b".!?")
    put("mark", b",;:'\"()-")
    put("bar", b"|")
    put("space", b" \t\r\v\f")
    put("line", b"\n")
    put("wide", range(128, 256))
    return out


def odds(hits: np.ndarray, n: np.ndarray, usual: float, weight: float) -> np.ndarray:
    """Log-odds of a share. ``weight`` things with the usual share count along, so that a short text
    shows little and does not look unusual only because it is short."""
    return np.log((hits + usual * weight) / (n - hits + (1 - usual) * weight))


def statistics(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics per text."""
    table, k = byte_kinds(), len(KINDS)
    data = [t.encode() for t in texts]
    counts = np.empty((len(data), k))
    more = np.empty((len(data), 6))
    for i, d in enumerate(data):
        counts[i] = np.bincount(table[np.frombuffer(d, np.uint8)], minlength=k)
        words = d.split()
        lines = [x for x in d.split(b"\n") if x]
        more[i] = (
            len(words), len(set(words)), sum(map(eq, words, words[1:])), len(set(zip(words, words[1:], strict=False))), len(lines), len(set(lines)),
        )
    c = dict(zip(KINDS, counts.T, strict=True))
    words, kinds, same, pairs, lines, other_lines = more.T
    n, letters, cased = counts.sum(1), c["lower"] + c["upper"] + c["wide"], c["lower"] + c["upper"]
    cols = [
        np.log((n + 60) / (words + 10)),
        odds(letters, n, 0.8, 40),
        odds(c["upper"], cased, 0.03, 40),
        odds(c["digit"], n, 0.005, 40),
        odds(c["mark"], n, 0.01, 40),
        odds(c["stop"], n, 0.015, 40),
        odds(c["symbol"], n, 0.002, 40),
        odds(c["line"], n, 0.003, 40),
        odds(c["bar"], n, 0.001, 40),
        odds(kinds, words, 0.8, 10),
        odds(same, words, 0.01, 10),
        odds(pairs, words, 0.97, 10),
        odds(other_lines, lines, 0.97, 3),
        np.log((words + 60) / (lines + 1)),
    ]
    return np.stack(cols, 1)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics of the whole text."""
    picked = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = picked.schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                x = statistics(part.column(1).to_pylist())
                ends = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["doc_id", "x"])

    return picked.mapInArrow(run, f"doc_id {kind}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per label: mean, inverse Cholesky factor of the shrunk covariance, log determinant, log prior."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    log_priors: list[float]
    only: float | None = None  # the score where one label or none was seen

    @classmethod
    def from_sums(cls, n: np.ndarray, sums: np.ndarray, outer: np.ndarray, to_pooled: float, to_diagonal: float) -> Discriminant:
        """``n``, ``sums`` and ``outer``: rows, sums of x and of x x' for labels 0 and 1."""
        if min(n) == 0:
            return cls([], [], [], [], 0.5 if max(n) == 0 else float(n[1] > 0))
        means = [s / k for s, k in zip(sums, n, strict=True)]
        covs = [o / k - np.outer(m, m) for o, k, m in zip(outer, n, means, strict=True)]
        pooled = sum(k * c for k, c in zip(n, covs, strict=True)) / sum(n)
        floor = np.maximum(np.diag(pooled), 1e-3)
        factors, dets = [], []
        for c in covs:
            s = (1 - to_pooled) * c + to_pooled * pooled
            s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + 1e-3 * np.diag(floor)
            low = np.linalg.cholesky(s)
            factors.append(np.linalg.inv(low))
            dets.append(2 * float(np.log(np.diag(low)).sum()))
        return cls(means, factors, dets, [float(np.log(k / sum(n))) for k in n])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        log = [
            lp - 0.5 * d - 0.5 * np.square((x - m) @ f.T).sum(1)
            for m, f, d, lp in zip(self.means, self.factors, self.log_dets, self.log_priors, strict=True)
        ]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(feats: DataFrame, labels: DataFrame, label: str = "quality", to_pooled: float = 0.05, to_diagonal: float = 0.05) -> Discriminant:
    """Learn from the rows of ``feats`` that have a label 0 or 1 in ``labels``."""
    d = len(NAMES)
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = b.column(0).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                out[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        at = np.arange(out.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.ravel())], ["at", "v"])

    parts = feats.join(rows, "doc_id").select("label", "x").mapInArrow(sums, "at long, v double")
    total = np.zeros(2 * (1 + d + d * d))
    for at, v in parts.groupBy("at").agg(F.sum("v")).collect():
        total[at] = v
    both = total.reshape(2, -1)
    return Discriminant.from_sums(both[:, 0], both[:, 1 : 1 + d], both[:, 1 + d :].reshape(2, d, d), to_pooled, to_diagonal)


def score(feats: DataFrame, model: Discriminant, cut: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 where the score is at least ``cut``) and the statistics ``x``."""
    d = len(NAMES)
    kind = feats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "x", "score", "predicted"])

    return feats.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, x array<double>, score double, predicted int")


def scorer(model: Discriminant) -> Callable[[Column], Column]:
    """A column function from text to score, for rows that keep their columns."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        parts = [model.score(statistics(texts.iloc[i : i + 512].tolist())) for i in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return lambda text: scored(F.coalesce(text, F.lit("")))
