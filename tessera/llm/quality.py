"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each text gives a vector of statistics (lengths, vocabulary, symbols, repeats), transformed so that they are roughly
Gaussian. For either class a mean and a covariance are estimated from sums over all labelled training rows; the covariance
is shrunk to the diagonal of the pooled one. A score compares the Gaussian log densities, whose Mahalanobis distances use
the inverse of the Cholesky factor that was computed once, on the driver, for the few statistics.

Defined cases: a null text counts as empty and is scored like any other, and so are rows without an id or with equal ids; a
very long text is read a megabyte of rows at a time; equal texts get equal scores; an empty table gives no rows; labels other than 0 and 1 or null are not used;
rows repeated in a table count as often as they occur; if training rows of a class are missing, every score is the share
of label 1 (0.5 without training rows); further columns of the input, also of clashing names, stay and play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import free_name
from tessera.llm.wordhash import Words, slices, utf8, words

#: ASCII classes whose share of all characters is a statistic.
CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": "0123456789",
    "vowels": "aeiouAEIOU",
    "stops": ".,;:",
    "shouts": "!?",
    "bars": "|",
    "symbols": "#$%&*+/<=>@[]^_`~",
}
STATISTICS = ["words", "vocabulary", "word_length", "longest_word", "lines", "same_lines", "same_words", *CLASSES]


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Number of different values in each row."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return np.bincount(row[new], minlength=n)


def statistics_of(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; logarithms and square roots pull in their tails."""
    text, begin = utf8(column)
    n = len(begin) - 1
    sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[begin])
    chars = sums((text & 0xC0) != 0x80)
    w = words(text, begin)
    many, hashes = np.diff(w.begin), w.hashes()
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.row, w.last - w.first)
    again = w.row[1:][(hashes[1:] == hashes[:-1]) & (w.row[1:] == w.row[:-1])]
    breaks = np.flatnonzero(text == 0x0A)
    # a line starts with each text and after each line break, and ends at the next break or with the text
    starts = np.concatenate((begin[:-1], breaks + 1))
    of = np.concatenate((np.arange(n), np.searchsorted(begin, breaks, side="right") - 1))
    order = np.lexsort((starts, of))
    starts, of = starts[order], of[order]
    ends = np.where(np.append(of[1:] == of[:-1], False), np.append(starts[1:], 0) - 1, begin[of + 1]) if len(of) else starts
    lines = np.bincount(of, minlength=n)
    line_hashes = Words(text, starts, ends, of, begin).hashes()
    share = 1.0 / np.maximum(chars, 1)
    out = [
        np.log1p(many),
        np.log((1 + _distinct(w.row, hashes, n)) / (1 + many)),
        np.log((1 + chars) / (1 + many)),
        np.log1p(longest),
        np.log((1 + lines) / (1 + many)),
        np.sqrt(1 - _distinct(of, line_hashes, n) / np.maximum(lines, 1)),
        np.sqrt(np.bincount(again, minlength=n) / np.maximum(many, 1)),
    ]
    for letters in CLASSES.values():
        table = np.zeros(256, dtype=bool)
        table[[ord(c) for c in letters]] = True
        out.append(np.sqrt(sums(table[text]) * share))
    return np.column_stack(out)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(text: pa.Array) -> pa.Array:
    parts = [statistics_of(part.column(0)) for part in slices(pa.record_batch([text], ["t"]), 0)]
    flat = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
    return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * len(STATISTICS), flat.ravel())


def with_statistics(docs: DataFrame, column: str = "q") -> DataFrame:
    """``docs`` and an array ``column`` of the STATISTICS of its ``text``."""
    return docs.withColumn(column, _statistics("text"))


@dataclass
class Discriminant:
    """prior: share of label 1. Per class: mean, inverse Cholesky factor, log determinant; empty if a class is missing."""

    prior: float
    classes: list[tuple[np.ndarray, np.ndarray, float]]
    scale: float = 1.0

    def log_odds(self, column: str = "q") -> str:
        """SQL of the log density difference; a constant if a class is missing."""
        base = float(np.log(self.prior / (1 - self.prior)))
        if not self.classes:
            return f"cast({base!r} AS double)"
        terms = []
        for mean, inverse, half_log_det in self.classes:
            rows = []
            for j in range(len(mean)):
                line = " + ".join(f"{float(inverse[j, k])!r}D * ({column}[{k}] - ({float(mean[k])!r}D))" for k in range(j + 1))
                rows.append(f"pow({line}, 2)")
            terms.append(f"(-0.5D * ({' + '.join(rows)}) - ({half_log_det!r}D))")
        return f"({terms[1]} - {terms[0]} + ({base!r}D))"

    def score(self, column: str = "q") -> str:
        return f"1 / (1 + exp(-greatest(-500D, least(500D, {self.scale!r}D * {self.log_odds(column)}))))"


def fit(training: DataFrame, shrinkage: float = 0.3, scale: float = 0.2, floor: float = 1e-4) -> Discriminant:
    """Estimate from ``q`` (statistics) and ``y`` (0 or 1); the sums come from one aggregation over all rows.

    shrinkage: weight of the pooled diagonal in each covariance. scale: factor on the log odds, since densities of
    correlated statistics are overconfident. floor: least variance.
    """
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.count("*").alias("n")] + [F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(d)]
    sums += [F.sum(F.col("q")[i] * F.col("q")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    rows = {r["y"]: r for r in training.filter("y IN (0, 1)").groupBy("y").agg(*sums).collect()}
    n = {y: rows[y]["n"] if y in rows else 0 for y in (0, 1)}
    total = n[0] + n[1]
    prior = min(max(n[1] / total if total else 0.5, 1e-6), 1 - 1e-6)
    if min(n.values()) < 2:
        return Discriminant(prior, [])
    means, covs = {}, {}
    for y in (0, 1):
        mean = np.array([rows[y][f"s{i}"] for i in range(d)]) / n[y]
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = rows[y][f"p{i}_{j}"] / n[y]
        means[y], covs[y] = mean, second - np.outer(mean, mean)
    pooled = np.maximum(np.diag((n[0] * covs[0] + n[1] * covs[1]) / total), floor)
    classes = []
    for y in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * covs[y] + shrinkage * np.diag(pooled) + floor * np.eye(d))
        classes.append((means[y], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    return Discriminant(prior, classes, scale)


def training_rows(statistics: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Labelled rows outside the held-out fifth (crc32 of the id as text, modulo 5, is 0)."""
    known = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("y"))
    known = known.filter("l_id IS NOT NULL AND crc32(cast(l_id AS string)) % 5 <> 0")
    return statistics.join(known, F.col("doc_id") == F.col("l_id")).select("q", "y")


def sample_labels(labels: DataFrame, label: str = "quality", most: int = 20_000) -> DataFrame:
    """l_id and y of at most ``most`` labelled rows outside the held-out fifth, those with the smallest hashes: a bounded table."""
    known = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("y")).filter("l_id IS NOT NULL AND y IN (0, 1) AND crc32(cast(l_id AS string)) % 5 <> 0")
    return known.orderBy(F.xxhash64("l_id"), "l_id", "y").limit(most)


def fit_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000) -> Discriminant:
    """Fit on a bounded sample of labelled documents, which is broadcast, so that statistics of no others are computed."""
    known = docs.select("doc_id", "text").join(F.broadcast(sample_labels(labels, label, most)), F.col("doc_id") == F.col("l_id"))
    return fit(with_statistics(known.repartition(docs.sparkSession.sparkContext.defaultParallelism)).select("q", "y"))


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is at least ``threshold``, with the columns they came with."""
    name = free_name(docs, "q_stats")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return with_statistics(docs, name).filter(f"{model.score(name)} >= {threshold}").select(*columns)
