"""Toxicity by a bag of subwords.

A word's character n-grams (3 to 6 bytes of the word between border marks)
hash to rows of an embedding table. A text's vectors are averaged and go
through a linear softmax; table and softmax are trained together in numpy
(Adam, weight decay) on a bounded sample of labelled texts. A misspelt word
shares most of its n-grams, and so its vectors, with the word that was seen.

Scoring uses the whole text. As the softmax is linear, each row of the table
shrinks to one number before scoring: a text's logit is the mean of its
n-grams' numbers. Averages are taken over short passages (two cells of CELL
bytes, overlapping by one), in training as in scoring, and a text takes the
score of its worst passage, so that length does not dilute what one says; a
logistic curve over that logit, the number of passages that look toxic and
the number of passages, fitted on labelled texts that the model has not seen,
turns it into the score. Training takes rounds: a toxic text need not be toxic
throughout, so later rounds learn from its worst passages only, and from those
passages of other texts that were mistaken for toxic ones.

Defined cases: a null text counts as empty; an empty text, and one without
n-grams, has the score of a bag with nothing in it, the softmax of the bias;
repeated rows are scored one by one; labelled rows with a null label or id,
and texts above SAMPLE_TEXT bytes, are not learned from (texts of any length
are scored, whole); an id with both labels counts as toxic; ties among rows to
learn from are broken by the text; if both labels aren't present, every score is the share
of label 1 (0.5 with no labels at all); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vec
from .common import crc_mod, text_or_empty

BITS, DIMENSIONS, SIZES = 18, 4, (3, 4, 5, 6)
#: The largest number of labelled texts that are learned from, and of bytes in one of them.
SAMPLE, SAMPLE_TEXT = 2400, 1 << 14
#: Bytes of half a passage; passages overlap by a half.
CELL = 16
#: Passages without toxic words that a round learns from: at random, and those that the last round took to be the most toxic.
RANDOM, HARDEST, ROUNDS = 16000, 12000, 4
#: Logit from which a passage of a toxic text is taken to be toxic itself.
SURE = 2.0
#: N-grams in fewer passages of the sample are not learned from.
MIN_COUNT = 8
U64 = np.uint64
SPACE = 0x20


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case with every separator as a space, and a space around each text; offsets of the texts' first spaces."""
    n = np.diff(offsets)
    out = np.full(len(data) + len(n) + 1, SPACE, np.uint8)
    low = np.where(vec.PLAIN_WORD[data], vec.folded(data), SPACE).astype(np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, len(n) + 1), n)] = low
    return out, offsets + np.arange(len(offsets))


def ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first byte in the padded buffer, bucket) of all n-grams, one size after another."""
    text, _ = _padded(data, offsets)
    n = len(text)
    space = text == SPACE
    last = np.maximum.accumulate(np.where(space, np.arange(n), -1))
    h = text.astype(U64)
    for j in range(1, max(SIZES)):
        factor = U64(pow(0x100000001B3, j, 1 << 64))
        h = h[:-1] + (text[j:].astype(U64) + U64(1)) * factor
        size = j + 1
        if size in SIZES and len(h) > 0:
            at = np.flatnonzero(last[size - 2 : size - 2 + len(h)] <= np.arange(len(h)))
            at = at[~(space[at] & space[at + 1])]
            yield at, (vec.mix(h[at]) >> U64(64 - BITS)).astype(np.int32)


class Model:
    """Embeddings and softmax, trained together."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        # Rows that training never meets stay at zero and say nothing.
        self.table = np.zeros((1 << BITS, DIMENSIONS), np.float32)
        self.weights = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def numbers(self) -> tuple[np.ndarray, float]:
        """Each bucket's share in the difference of the two logits, and the difference of the biases."""
        return (self.table @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])

    def fit(self, bags: Passages, chosen: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.02, decay: float = 1e-3, seed: int = 0) -> None:
        """Learn label y[i] from passage chosen[i]; weight: of each label."""
        rng = np.random.default_rng(seed)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.table, self.weights, self.bias)]
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            step = rate * (1 - epoch / epochs) + rate * 0.05
            for a in range(0, len(y), batch):
                t += 1
                some = order[a : a + batch]
                owner, index, share = bags.take(chosen[some])
                rows = self.table[index]
                mean = np.stack([np.bincount(owner, share * rows[:, d], len(some)) for d in range(DIMENSIONS)], 1).astype(np.float32)
                logits = mean @ self.weights + self.bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(some)), y[some]] -= 1
                g = p * (weight[y[some], None] / len(some))
                g_mean = g @ self.weights.T
                used, place = np.unique(index, return_inverse=True)
                g_table = np.stack([np.bincount(place, share * g_mean[owner, d], len(used)) for d in range(DIMENSIONS)], 1)
                # Only rows of the table that the batch used are moved.
                grads = (g_table.astype(np.float32), mean.T @ g, g.sum(0))
                for p_, grad, (m, v), at in zip((self.table, self.weights, self.bias), grads, state, (used, ..., ...), strict=True):
                    m[at] += 0.1 * (grad - m[at])
                    v[at] += 0.01 * (grad * grad - v[at])
                    p_[at] -= step * ((m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.99**t)) + 1e-8) + decay * p_[at])


def cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """(first cell of each text, and a last one; (cell, bucket) of all n-grams, one size after another). A text has one cell at least."""
    starts = offsets + np.arange(len(offsets))
    n = np.diff(starts) // CELL + 1
    first = np.r_[0, np.cumsum(n)]
    row = np.repeat(np.arange(len(n)), np.diff(starts))
    place = first[:-1][row] + (np.arange(starts[-1]) - starts[:-1][row]) // CELL

    def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at, bucket in ngrams(data, offsets):
            yield place[at], bucket

    return first, each()


class Passages:
    """Bags of all passages (two cells, not overlapping) of a bounded sample: buckets and counts by passage, and each passage's text."""

    def __init__(self, column: pa.Array):
        lengths, rows = [], []
        # Room for all n-grams at once: the driver holds the sample in one copy.
        room = len(SIZES) * (int(pc.sum(pc.binary_length(column)).as_py() or 0) + 2 * len(column))
        self.buckets, self.counts, n_all = np.empty(room, np.uint32), np.empty(room, np.uint8), 0
        for a, _, data, offsets in vec.blocks(column, 1 << 17):
            first, each = cells(data, offsets)
            cell, bucket = (np.concatenate(x) for x in zip(*each, strict=True))
            row = np.searchsorted(first, cell, "right") - 1
            key, n = np.unique((cell - (cell - first[row]) % 2).astype(np.int64) << BITS | bucket, return_counts=True)
            cell = key >> BITS
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(key) else np.zeros(0, np.int64)
            self.buckets[n_all : n_all + len(key)] = key & ((1 << BITS) - 1)
            self.counts[n_all : n_all + len(key)] = np.minimum(n, 255)
            n_all += len(key)
            lengths.append(np.diff(np.r_[start, len(key)]))
            rows.append(a + np.searchsorted(first, cell[start], "right") - 1)
        self.buckets, self.counts = self.buckets[:n_all], self.counts[:n_all]
        self.to = np.r_[0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *lengths]))].astype(np.int64)
        self.row = np.concatenate([np.zeros(0, np.int64), *rows])
        self.common = np.bincount(self.buckets, minlength=1 << BITS) >= MIN_COUNT

    def take(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `chosen`, bucket, share of its passage) of all n-grams of some passages."""
        n = self.to[chosen + 1] - self.to[chosen]
        at = np.repeat(self.to[chosen] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        owner = np.repeat(np.arange(len(chosen)), n)
        count, bucket = self.counts[at].astype(np.float32), self.buckets[at].astype(np.int64)
        return owner, bucket, self.common[bucket] * count / np.bincount(owner, count)[owner].astype(np.float32)

    def logits(self, numbers: np.ndarray, bias: float) -> np.ndarray:
        out = np.empty(len(self.row))
        for a in range(0, len(out), 4000):
            b = min(a + 4000, len(out))
            owner, index, share = self.take(np.arange(a, b))
            out[a:b] = np.bincount(owner, share * numbers[index], b - a)
        return out + bias


def text_features(column: pa.Array, numbers: np.ndarray, bias: float) -> np.ndarray:
    """Three numbers for each text: the logit of its worst passage, how many passages look toxic (log), and how many there are (log)."""
    out = np.zeros((len(column), 3))
    for a, b, data, offsets in vec.blocks(column):
        first, each = cells(data, offsets)
        total, count = np.zeros(first[-1] + 1), np.zeros(first[-1] + 1)
        for cell, bucket in each:
            total += np.bincount(cell, numbers[bucket], len(total))
            count += np.bincount(cell, minlength=len(count))
        inner = np.ones(first[-1], bool)
        inner[first[1:] - 1] = False  # the last cell of a text has no right neighbour
        mean = bias + np.where(inner, total[:-1] + total[1:], total[:-1]) / np.maximum(1, np.where(inner, count[:-1] + count[1:], count[:-1]))
        out[a:b, 0] = np.maximum.reduceat(mean, first[:-1])
        out[a:b, 1] = np.log1p(np.add.reduceat(1 / (1 + np.exp(-np.clip(mean, -30, 30))), first[:-1]))
        out[a:b, 2] = np.log(np.diff(first))
    return out


def scores(column: pa.Array, numbers: np.ndarray, bias: float, curve: np.ndarray) -> np.ndarray:
    x = text_features(column, numbers, bias)
    return 1 / (1 + np.exp(-np.clip(x @ curve[:-1] + curve[-1], -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights and shift of a logistic curve from a text's features to the probability of label 1 (Newton steps, light ridge)."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    start = np.array([1.0, 0.0, 0.0, 0.0])
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4)
        w = w + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * (w - start)), -1, 1)
    return w


def train(texts: pa.Array, labels: np.ndarray, positive: float | None = None, seed: int = 0) -> tuple[np.ndarray, float, np.ndarray]:
    """Numbers by bucket, bias and calibrating curve. Four fifths of the labelled texts train the model, the rest calibrate it.

    `positive` is the share of label 1 among all labelled texts, if the sample has another.
    """
    if len(np.unique(labels)) == 2:
        own = np.arange(len(labels)) % 5 == 0
        if len(np.unique(labels[own])) < 2 or len(np.unique(labels[~own])) < 2:
            own[:] = True
        rest = ~own if not own.all() else own
        weight = np.ones(len(labels))
        if positive:
            drawn = labels[own].mean()
            weight = np.where(labels == 1, positive / drawn, (1 - positive) / (1 - drawn))
        numbers, bias = learn(texts.take(pa.array(np.flatnonzero(rest))), labels[rest], seed)
        held = np.flatnonzero(own)
        return numbers, bias, calibrate(text_features(texts.take(pa.array(held)), numbers, bias), labels[held], weight[held])
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    return np.zeros(1 << BITS, np.float32), 0.0, np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))])


def learn(texts: pa.Array, labels: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Numbers by bucket and bias; passages carry their text's label at first."""
    rng = np.random.default_rng(seed)
    bags = Passages(texts)
    toxic = labels[bags.row] == 1
    clean, guilty = np.flatnonzero(~toxic), np.flatnonzero(toxic)
    sample = rng.choice(clean, min(RANDOM, len(clean)), replace=False)
    bad = rng.choice(guilty, min(RANDOM, len(guilty)), replace=False)
    for turn in range(ROUNDS):
        model = Model(seed)
        y = np.repeat([0, 1], [len(sample), len(bad)])
        model.fit(bags, np.r_[sample, bad], y, np.array([1.0, len(sample) / (4 * len(bad))], np.float32), seed=seed)
        if turn == ROUNDS - 1:
            return model.numbers()
        # A toxic text need not be toxic throughout: learn again from its worst passage, from others as bad, and from what was mistaken for them.
        logits = bags.logits(*model.numbers())
        order = guilty[np.lexsort((-logits[guilty], bags.row[guilty]))]
        worst = order[np.r_[True, bags.row[order][1:] != bags.row[order][:-1]]]
        bad = np.unique(np.r_[worst, guilty[logits[guilty] > SURE]])
        hardest = clean[np.argsort(-logits[clean], kind="stable")[:HARDEST]]
        sample = np.unique(np.r_[rng.choice(clean, min(RANDOM, len(clean)), replace=False), hardest])
    raise AssertionError


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, condition: Column, bound: int = SAMPLE) -> tuple[DataFrame, float]:
    """At most `bound` labelled rows (key, text, y), half of each label as far as there are so many, chosen by a hash of the id; and the share of label 1 among all."""
    # An id with both labels counts as 1.
    marks = labels.select(F.col(key), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col(key).isNotNull() & condition).groupBy(key).agg(F.max("y").alias("y"))
    n = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    share = F.lit(0)
    for y in (0, 1):
        share = F.when(F.col("y") == y, int((1 << 20) * min(1.0, 1.1 * (bound // 2) / max(1, n.get(y, 0))))).otherwise(share)
    some = marks.filter(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 20)) < share)
    texts = docs.select(F.col(key), text_or_empty(text).alias("text")).filter(F.octet_length("text") <= SAMPLE_TEXT)
    # About 1.1 times `bound` ids, so a broadcast of bounded size. The bound holds after the join, as an id may have many rows.
    joined = texts.join(F.broadcast(some), key)
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64(key), "text"))
    return joined.withColumn("_place", place).filter(F.col("_place") <= bound // 2).select(key, "text", "y"), n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(key, 5) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, held_out, score, predicted, and the columns to carry) for every row of `docs`, learned from labels of rows that are not held out."""
    sample, positive = labelled(docs, labels, key, text, label, ~held_out(key), bound)
    sample = sample.orderBy(F.xxhash64(key), "text").toArrow()
    fitted = train(sample["text"].combine_chunks() if sample.num_rows else pa.array([], pa.string()), np.array(sample["y"].to_pylist(), int), positive)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    kind = docs.schema[key].dataType.simpleString()
    carried = [f"_carry{i}" for i in range(len(carry))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), *model.value)), *batch.columns[2:]], names=[key, "score", *carried])
        vec.tidy()

    rows = docs.select(F.col(key), text_or_empty(text).alias("_text"), *(F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)))
    types = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(carry, carried, strict=True))
    scored = rows.mapInArrow(score, f"{key} {kind}, score double{types}")
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(F.col(n).alias(c) for c, n in zip(carry, carried, strict=True)))
