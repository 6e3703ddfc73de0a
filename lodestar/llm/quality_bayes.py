"""Quality by hierarchical empirical Bayes.

A document classifier (logistic regression over text statistics, fitted in
numpy on a bounded sample of labelled rows) gives each document its evidence.
Documents are grouped by host and by path below the host. A group's raw mean of
evidence is shrunk toward its parent's: the path toward its host, the host
toward the global mean, with a prior weight estimated from the spread between
groups (method of moments), so that sparse sites lie near the prior and large
ones near their own mean. A document's score adds its own evidence to the
log-odds by which its path differs from the global mean.

All group statistics are sums by group, combined before the shuffle; a group's
rows never meet in one task.

Defined cases: a null text counts as empty; a null host or path is a group of
its own, whatever names there are; repeated rows count as often as they occur;
very long texts are described whole; labelled rows with a null label or id are
not learned from; an id with both labels counts as 0; with fewer than two labels the evidence is
the share of label 1 (0.5 without labels); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import crc_mod, if_small, keep, text_or_empty

#: The largest number of labelled texts that are learned from.
SAMPLE = 6000
#: How many numbers describe a text.
STATISTICS = 17
#: Bounds of a prior's weight, in documents.
PRIOR = (1.0, 1e6)
_SYMBOL, _DIGIT, _UPPER, _NOT_LINE = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT[list(b"0123456789")] = True
_UPPER[ord("A") : ord("Z") + 1] = True
_NOT_LINE[:] = True
_NOT_LINE[10] = False


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(1, whole)


def _repeated(h: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Share of values that occur before in their row."""
    n = np.diff(to)
    return _share(n - np.diff(vec.distinct_sorted(h, to)[1]), n)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of text statistics per text, over the whole of it."""
    parts = []
    for _, _, data, offsets in vec.blocks(column):
        h, _, _, at = vec.words(data, offsets)
        lines, _, _, line_at = vec.words(data, offsets, _NOT_LINE)
        n, n_bytes, n_lines = np.diff(at), np.diff(offsets), np.diff(line_at)
        count = lambda table: np.diff(np.r_[0, np.cumsum(table[data])][offsets])
        word_bytes = count(vec._IS_WORD)
        parts.append(np.stack([
            np.log1p(n), _share(word_bytes, n), _share(n_bytes, n_lines) ** 0.5, _share(count(_SYMBOL), n), _share(count(_DIGIT), n_bytes), _share(count(_UPPER), n_bytes),
            _repeated(h, at), _repeated(*vec.shingles(h, at, 3)), _repeated(lines, line_at),
        ], 1))
    raw = np.concatenate(parts) if parts else np.zeros((0, 9))
    # Small shares matter most: steep near zero, flat above.
    steep = np.log1p(50 * np.clip(raw[:, 3:], 0, 1))
    length = np.log1p(raw[:, 1])
    return np.concatenate([raw[:, :1], raw[:, :1] ** 2 / 10, length[:, None], length[:, None] ** 2, raw[:, 2:3], raw[:, 3:], steep], 1)


class Evidence:
    """Logistic regression on standardised statistics."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(STATISTICS), np.ones(STATISTICS))
        self.weights = np.zeros(len(self.mean) + 1)
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.weights[-1] = np.log(share / (1 - share))
        if len(np.unique(y)) == 2:
            z = self._design(x)
            penalty = ridge * np.r_[np.ones(z.shape[1] - 1), 1e-6]
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
                h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
                self.weights += np.clip(np.linalg.solve(h, z.T @ (y - p) - penalty * self.weights), -2, 2)

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - self.mean) / self.scale, -6, 6), np.ones((len(x), 1))], 1)

    def logits(self, column: pa.Array) -> np.ndarray:
        return np.clip(self._design(statistics(column)) @ self.weights, -12, 12)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _name(c: Column) -> Column:
    """A group's name that no other has: null gives the empty string, all else starts with a sign."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def prior_weight(groups: DataFrame, parent_mean: Column) -> float:
    """How many documents the parent's mean is worth: the ratio of the variance within groups to that between them.

    `groups` has n, s (sum of evidence) and q (sum of its squares).
    """
    mean = F.col("s") / F.col("n")
    r = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("q") - F.col("n") * mean * mean).alias("within"),
        F.sum(F.col("n") * (mean - parent_mean) ** 2).alias("between"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    if not r["n"] or r["k"] < 2 or r["n"] <= r["k"]:
        return PRIOR[1]
    within = max(r["within"], 0.0) / (r["n"] - r["k"])
    spread = (r["between"] - (r["k"] - 1) * within) / max(1e-9, r["n"] - r["nn"] / r["n"])
    return float(np.clip(within / spread if spread > 1e-12 else PRIOR[1], *PRIOR))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(key, 5) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = SAMPLE) -> DataFrame:
    """(key, held_out, evidence, host_posterior, path_posterior, score, kept) for every row of `docs`."""
    marks = labels.select(F.col(key), F.col(label).cast("double").alias("y")).filter(F.col("y").isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.min("y").alias("y"))
    n = marks.count()
    marks = marks.filter(F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.05 * bound / max(1, n)))).orderBy(F.xxhash64(key)).limit(bound)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "y", "place"])

    # No more than `bound` ids, so a broadcast of bounded size; statistics, not texts, go to the driver, of no more than `bound` rows, as an id may have many.
    chosen = docs.select(F.col(key), text_or_empty(text).alias("text")).join(F.broadcast(marks), key).select("text", "y", F.xxhash64(key).alias("place"))
    sample = chosen.mapInArrow(described, "x array<double>, y double, place long").orderBy("place", "x").limit(bound).toPandas()
    # Rows arrive in any order; a fixed one makes the fit repeatable.
    x = np.array(sample["x"].tolist(), float).reshape(len(sample), STATISTICS)
    y = sample["y"].to_numpy(float)
    order = np.lexsort(np.c_[x, y].T) if len(y) else slice(None)
    model = docs.sparkSession.sparkContext.broadcast(Evidence(x[order], y[order]))
    kind = docs.schema[key].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(model.value.logits(batch.column(3)))], names=[key, "host", "path", "logit"])
        vec.tidy()

    rows = docs.select(F.col(key), _name(host).alias("host"), _name(path).alias("path"), text_or_empty(text).alias("text"))
    seen = keep(rows.mapInArrow(weigh, f"{key} {kind}, host string, path string, logit double").withColumn("evidence", 1 / (1 + F.exp(-F.col("logit")))), "evidence")

    sums = lambda *by: (F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") * F.col("evidence")).alias("q"))
    paths = keep(seen.groupBy("host", "path").agg(*sums()), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = paths.agg(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.5)).alias("m")).first()["m"]
    weight = prior_weight(hosts, F.lit(total))
    hosts = hosts.select("host", ((F.col("s") + weight * total) / (F.col("n") + weight)).alias("host_posterior"))
    n_paths = paths.count()
    paths = paths.join(if_small(hosts, 96, n_paths), "host")
    weight = prior_weight(paths, F.col("host_posterior"))
    paths = paths.select("host", "path", "host_posterior", ((F.col("s") + weight * F.col("host_posterior")) / (F.col("n") + weight)).alias("path_posterior"))
    score = 1 / (1 + F.exp(-(F.col("logit") + _logit(F.col("path_posterior")) - _logit(F.lit(total)))))
    joined = seen.join(if_small(paths, 160, n_paths), ["host", "path"])
    return joined.select(key, held_out(key).alias("held_out"), "evidence", "host_posterior", "path_posterior", score.alias("score")).withColumn("kept", F.col("score") >= 0.5)
