"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each window of
WINDOW positions keeps every filter's largest response, and a softmax over
the kept responses gives the language. Embeddings, filters and softmax are
trained together in numpy (Adam) on windows of a bounded sample of labelled
texts. A whole text is read window by window; its logits are the mean over
its windows, weighted by their lengths.

Applying the network needs no multiplication: a filter's answer at a position
is a sum of table entries (byte embedding times filter tap), two neighbouring
bytes at a time, for all positions of a block of texts at once.

Defined cases: a null text, or one without a letter, is `und` with score 0;
rows with a null language are not learned from; with no labelled row at all
every text is `und`; repeated rows are predicted one by one; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import crc_mod, text_or_empty

WIDTHS, FILTERS, DIMENSIONS = (2, 3, 4), 8, 8
WINDOW, PAD = 256, 4
#: The largest number of labelled texts, of windows from each, and of bytes in one of them, that are learned from.
SAMPLE, SAMPLE_WINDOWS, SAMPLE_TEXT = 3000, 6, 1 << 16
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with PAD zeros after each text and at the end, first position of each window, its number of positions, its text).

    A text has one position more than bytes, so an empty one has one too; the
    zeros after it keep every filter within the text.
    """
    n = np.diff(offsets)
    starts = offsets[:-1] + PAD * np.arange(len(n))
    out = np.zeros(len(data) + PAD * len(n) + PAD, np.uint8)
    out[np.arange(len(data)) + PAD * np.repeat(np.arange(len(n)), n)] = data
    count = n // WINDOW + 1
    row = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return out, starts[row] + WINDOW * place, np.minimum(WINDOW, n[row] + 1 - WINDOW * place), row


class Network:
    def __init__(self, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.5, (256, DIMENSIONS)).astype(np.float32)
        self.filters = [rng.normal(0, 0.5 / w, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.weights = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    def taps(self) -> list[list[np.ndarray]]:
        """For each width and offset the table byte -> share in each filter's response."""
        return [[self.embedding @ tap for tap in f] for f in self.filters]

    def step(self, x: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients on windows x (bytes, n x (WINDOW + PAD)), of which the first `length` positions count."""
        n, beyond = len(y), np.arange(WINDOW)[None, :] >= length[:, None]
        features, where = [], []
        for w, tables in zip(WIDTHS, self.taps(), strict=True):
            r = sum(t[x[:, j : j + WINDOW]] for j, t in enumerate(tables))
            r[beyond] = -1e9
            at = r.argmax(1)
            features.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0, :])
            where.append(at)
        feature = np.concatenate(features, 1)
        active = np.maximum(feature, 0)
        logits = active @ self.weights + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(p[np.arange(n), y] + 1e-9).mean())
        p[np.arange(n), y] -= 1
        p /= n
        g = (p @ self.weights.T) * (feature > 0)
        g_embedding, g_filters = np.zeros_like(self.embedding), []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            own = g[:, k * FILTERS : (k + 1) * FILTERS]
            g_f = np.zeros_like(f)
            for j in range(w):
                byte = np.take_along_axis(x, where[k] + j, 1)
                table = np.zeros((256, FILTERS), np.float32)
                np.add.at(table, (byte, np.arange(FILTERS)[None, :]), own)
                g_f[j] = self.embedding.T @ table
                g_embedding += table @ f[j].T
            g_filters.append(g_f)
        return loss, [g_embedding, *g_filters, active.T @ p, p.sum(0)]

    def fit(self, x: np.ndarray, length: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        own = [self.embedding, *self.filters, self.weights, self.bias]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in own]
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), batch):
                t += 1
                some = order[a : a + batch]
                _, grads = self.step(x[some], length[some], y[some])
                for p, g, (m, v) in zip(own, grads, state, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (1 - 0.9 * epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)


class Applied:
    """The trained network as tables over pairs of bytes."""

    def __init__(self, network: Network, languages: list[str]):
        self.languages, self.weights, self.bias = languages, network.weights, network.bias
        self.tables = []
        for tables in network.taps():
            pairs = [(tables[j][:, None, :] + tables[j + 1][None, :, :]).reshape(-1, FILTERS) for j in range(0, len(tables) - 1, 2)]
            self.tables.append((pairs, tables[-1] if len(tables) % 2 else None))

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """One row of class probabilities per text."""
        out = np.zeros((len(column), len(self.languages)))
        for a, b, data, offsets in vec.blocks(column, 1 << 18):
            x, first, length, row = windows(data, offsets)
            n = len(x) - PAD
            # Positions after a text, from which a filter would reach into the next one.
            after = (first + length)[np.r_[row[1:] != row[:-1], True]][:, None] + np.arange(PAD - 1)
            pair = x[:-1].astype(np.int32) * 256 + x[1:]
            features = []
            for pairs, odd in self.tables:
                r = pairs[0][pair[:n]]
                for j, table in enumerate(pairs[1:], 1):
                    r += table[pair[2 * j : 2 * j + n]]
                if odd is not None:
                    r += odd[x[2 * len(pairs) : 2 * len(pairs) + n]]
                r[after.ravel()] = -1e9
                features.append(np.maximum.reduceat(r, first, axis=0))
            logits = np.maximum(np.concatenate(features, 1), 0) @ self.weights + self.bias
            weight = length.astype(np.float64)
            total = np.stack([np.bincount(row, weight * logits[:, c], b - a) for c in range(logits.shape[1])], 1) / np.bincount(row, weight, b - a)[:, None]
            p = np.exp(total - total.max(1, keepdims=True))
            out[a:b] = p / p.sum(1, keepdims=True)
        return out


def train(texts: pa.Array, languages: list[str], seed: int = 0) -> Applied | None:
    """Learn from a bounded sample of labelled texts; None without any."""
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    xs, lengths, ys = [], [], []
    for a, _, data, offsets in vec.blocks(texts):
        x, first, length, row = windows(data, offsets)
        # A few windows of each text, at random places of the whole of it.
        chance = np.lexsort((rng.random(len(row)), row))
        rank = np.arange(len(row)) - np.searchsorted(row, row[chance])
        chosen = chance[rank < SAMPLE_WINDOWS]
        at = np.minimum(first[chosen][:, None] + np.arange(WINDOW + PAD), len(x) - 1)
        xs.append(x[at])
        lengths.append(length[chosen])
        ys.append(a + row[chosen])
    y = np.searchsorted(names, languages)
    network = Network(len(names), seed)
    network.fit(np.concatenate(xs), np.concatenate(lengths), y[np.concatenate(ys)], seed=seed)
    return Applied(network, names)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(key, 4) == 2, F.lit(False))


def labelled(docs: DataFrame, key: str, text: str, lang: str, bound: int) -> DataFrame:
    """At most `bound` rows (text, lang) that may be learned from, chosen by a hash of the id."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= SAMPLE_TEXT) & ~held_out(key))
    n = rows.count()
    few = rows.filter(F.pmod(F.xxhash64(key, F.lit(23)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.05 * bound / max(1, n))))
    return few.select(key, F.col(text).alias("text"), F.col(lang).alias("lang")).orderBy(F.xxhash64(key), "text", "lang").limit(bound)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, held_out, lang_pred, score, and the columns to carry) for every row of `docs`."""
    sample = labelled(docs, key, text, lang, bound).toArrow()
    model = train(sample["text"].combine_chunks(), sample["lang"].to_pylist()) if sample.num_rows else None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    carried = [f"_carry{i}" for i in range(len(carry))]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        applied = shared.value
        for batch in batches:
            letter = np.array(batch.column(2).to_pylist(), bool)
            if applied is None:
                names, score = np.full(len(letter), UNKNOWN, object), np.zeros(len(letter))
            else:
                p = applied.probabilities(batch.column(1))
                names, score = np.array(applied.languages, object)[p.argmax(1)] if len(p) else np.zeros(0, object), p.max(1) if len(p) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(letter, names, UNKNOWN), pa.string()), pa.array(np.where(letter, score, 0.0)), *batch.columns[3:]], names=[key, "lang_pred", "score", *carried])
        vec.tidy()

    rows = docs.select(F.col(key), text_or_empty(text).alias("text"), text_or_empty(text).rlike(r"\p{L}").alias("letter"), *(F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)))
    types = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(carry, carried, strict=True))
    found = rows.mapInArrow(predict, f"{key} {kind}, lang_pred string, score double{types}")
    return found.select(key, held_out(key).alias("held_out"), "lang_pred", "score", *(F.col(n).alias(c) for c, n in zip(carry, carried, strict=True)))
