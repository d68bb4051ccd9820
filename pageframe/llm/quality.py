"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm.texts import byte_words
from pageframe.sources.readers import bounded_batches

#: Bytes by kind, for the shares of a text.
KINDS = ["upper", "digit", "stop", "mark", "symbol", "line"]
_KIND_OF = np.zeros(256, np.uint8)
for _number, _chars in enumerate(
    [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".?,;:", b"!", b"#$%&*+/<=>@[\\]^_`{|}~", b"\n"], 1
):
    _KIND_OF[list(_chars)] = _number

FEATURES = [
    "log_words",
    "log_word_bytes",
    *KINDS,
    "distinct_words",
    "repeated_words",
    "lone_symbols",
]

FEW_WORDS = 10


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text, FEATURES in order; empty and null texts have all zeros.

    Counts enter as logarithms and shares as arcsines of their roots, which brings both nearer to a normal
    distribution and keeps the variance of a share from depending on it.
    """
    words = byte_words(text)
    n = len(words)
    if n == 0:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(_KIND_OF[data], minlength=len(KINDS) + 1)[1:]
    letters = max(1, sum(map(len, words)))
    distinct = len(set(words))
    repeated = sum(map(eq, words, words[1:])) if n > 1 else 0
    lone = sum(1 for w in words if len(w) == 1 and _KIND_OF[w[0]] == 5)
    # A share of few words says little; the added words keep one chance repeat from looking like a habit.
    some_words, some_letters = n + FEW_WORDS, letters + 5 * FEW_WORDS
    shares = [min(1.0, c / some_letters) for c in counts[:-1]] + [min(1.0, counts[-1] / some_words)]
    spread = np.log1p(distinct + FEW_WORDS) / np.log1p(some_words)
    shares += [repeated / some_words, lone / some_words]
    arcs = np.arcsin(np.sqrt(shares)).tolist()
    return [float(np.log1p(n)), float(np.log(letters / n)), *arcs[: len(KINDS)], float(spread), *arcs[len(KINDS) :]]


def _statistics_of(texts: pa.Array) -> pa.Array:
    """One text at a time as Python objects, so a batch takes little beside itself."""
    return pa.array((statistics(text.as_py()) for text in texts), pa.list_(pa.float64()), size=len(texts))


def statistics_of(text: Column | str) -> Column:
    return F.arrow_udf(_statistics_of, "array<double>")(text)


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians, kept as means and Cholesky factors of their shrunken covariances, and the prior log-odds."""

    means: dict[int, np.ndarray] = field(default_factory=dict)
    factors: dict[int, np.ndarray] = field(default_factory=dict)
    log_odds: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of each row of `x`, from the difference of the Mahalanobis log-densities."""
        odds = np.full(len(x), self.log_odds)
        for label, sign in ((1, 1.0), (0, -1.0)):
            if label in self.means:
                lower = self.factors[label]
                z = np.linalg.solve(lower, (x - self.means[label]).T)
                odds += sign * (-0.5 * (z * z).sum(axis=0) - np.log(np.diag(lower)).sum())
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -700.0, 700.0)))


def moments(rows: DataFrame, x_col: str, label_col: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products for each label, added up by Spark: one fixed-size row a label and task."""
    k = len(FEATURES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros(1 + k + k * k), 1: np.zeros(1 + k + k * k)}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for label in total:
                own = x[labels == label]
                total[label] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for label, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([sums.tolist()])], ["label", "sums"])

    parts = rows.select(F.col(x_col).alias("x"), F.col(label_col).cast("int").alias("label")).mapInArrow(
        partial, "label int, sums array<double>"
    )
    cells = parts.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("value"))
    out = {label: np.zeros(1 + k + k * k) for label in (0, 1)}
    for row in cells.collect():  # 2 (1 + k + k²) numbers
        out[row["label"]][row["pos"]] = row["value"]
    return {label: (s[0], s[1 : 1 + k], s[1 + k :].reshape(k, k)) for label, s in out.items() if s[0] > 0}


def fit(rows: DataFrame, x_col: str = "x", label_col: str = "label", shrink: float = 0.1, floor: float = 1e-3) -> Discriminant:
    """Fits the discriminant to all labelled rows through their sufficient statistics; nothing is sampled.

    A class covariance S becomes (1 - shrink) S + shrink diag(S) + floor I, so it can be inverted whatever the rows.
    With one label alone, or none, the scores are the share of label 1 (0.5 without rows).
    """
    sums = moments(rows, x_col, label_col)
    n = {label: sums[label][0] if label in sums else 0.0 for label in (0, 1)}
    log_odds = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    if len(sums) < 2:
        return Discriminant(log_odds=log_odds)
    means, factors = {}, {}
    for label, (count, total, outer) in sums.items():
        mean = total / count
        cov = outer / count - np.outer(mean, mean)
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + floor * np.eye(len(mean))
        means[label], factors[label] = mean, np.linalg.cholesky(cov)
    return Discriminant(means, factors, log_odds)


def score_column(model: Discriminant, x: Column | str) -> Column:
    def scored(values: pa.Array) -> pa.Array:
        rows = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        return pa.array(model.score(rows))

    return F.arrow_udf(scored, "double")(x)


def is_held_out(id_col: Column | str) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def labelled(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(x, label) of the rows to learn from. An id labelled more than once takes the commoner label, 1 in a tie."""
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(id_col))
        .groupBy(id_col)
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    )
    return stats.join(known, id_col).select("x", "label")


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return bounded_batches(docs).select(F.col(id_col), statistics_of(text_col).alias("x"))


def quality_scores(stats: DataFrame, model: Discriminant, id_col: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) for every row of `stats`; predicted is 1 from `threshold` on."""
    scored = stats.select(id_col, is_held_out(id_col).alias("held_out"), score_column(model, "x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
