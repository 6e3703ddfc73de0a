"""Benchmark decontamination: word pairs as seeds, then local alignment.

Item and document words (letters and digits, in lower case) are compared by
hash. The score is the best local alignment's (Smith-Waterman, word by word)
share of a perfect one, which scores exact, edited and paraphrased copies
alike. The seeds lose no pair of document and item that reaches `min_score`:

* an alignment of M words with X errors scores 2M - X. If that is T or more,
  X <= 2M - T, so its part of the document has at most 3n - T words, for an
  item of n words;
* of its M - 1 steps from one matched word to the next, at most X / 2 have two
  errors or more. Any other step goes one or two words on in the item and one
  or two in the document, so at least T / 2 - 1 words of the document start a
  pair, of next words or of next but one, that is also such a pair of the item.

A document is aligned with an item wherever so many of the item's pairs stand
within so many words, however many documents hold them: first for the score
alone, many passages side by side, then, where it is reached, for its place.

The items are broadcast; a benchmark whose size, which is checked, is not small
is taken in parts.

Defined cases: null texts, and texts with no words, match nothing; an item
with fewer than `size` words is sought as a whole; repeated rows of documents
or items give repeated matches of the same pair, returned once; an empty table
gives an empty result; rows with null ids take part with a null id; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import BROADCAST_BYTES, text_or_empty

SIZE = 5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of a perfect alignment, and least number of words in the item's aligned part.
MIN_SCORE, MIN_WORDS = 0.5, 8
#: So many items are looked up at once, which bounds how many a frequent pair can lead to.
SLICE = 1024
U64 = np.uint64


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(best score, start and end of its part of the passage) of the local alignment of two word sequences."""
    n, m = len(item), len(passage)
    score, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1) * -GAP
    best, best_from, best_to = 0, 0, 0
    for i in range(n):
        diagonal = score[:-1] + np.where(passage == item[i], MATCH, MISMATCH)
        up = score[1:] + GAP
        here = np.maximum(diagonal, up)
        origin = np.where(diagonal >= up, start[:-1], start[1:])
        origin = np.where(here <= 0, np.arange(1, m + 1), origin)
        here = np.r_[0, np.maximum(here, 0)]
        origin = np.r_[0, origin]
        # Gaps along the passage: a running maximum of score plus distance.
        run = np.maximum.accumulate(here + steps)
        source = np.maximum.accumulate(np.where(here + steps == run, np.arange(m + 1), 0))
        gapped = run - steps
        origin = np.where(gapped > here, origin[source], origin)
        score, start = np.maximum(gapped, 0), origin
        j = int(np.argmax(score))
        if score[j] > best:
            best, best_from, best_to = int(score[j]), int(start[j]), j
    return best, best_from, best_to


def best_scores(items: list[np.ndarray], passages: list[np.ndarray], cells: int = 1 << 18) -> np.ndarray:
    """The best scores alone of many alignments, those of passages of similar length side by side in one array."""
    out = np.zeros(len(items), np.int64)
    order = np.argsort([len(p) for p in passages], kind="stable")
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and len(passages[order[stop]]) * (stop + 1 - at) <= cells:
            stop += 1
        some = order[at:stop]
        n, m = max(len(items[k]) for k in some), max(len(passages[k]) for k in some)
        # Places behind an end hold values that do not occur on the other side.
        a, p = np.zeros((len(some), n), U64), np.ones((len(some), m), U64)
        for row, k in enumerate(some.tolist()):
            a[row, : len(items[k])], p[row, : len(passages[k])] = items[k], passages[k]
        score, slope = np.zeros((len(some), m + 1), np.int32), np.arange(m + 1, dtype=np.int32) * -GAP
        best = np.zeros(len(some), np.int32)
        for i in range(n):
            step = np.where(p == a[:, i : i + 1], np.int32(MATCH), np.int32(MISMATCH))
            step += score[:, :-1]
            score += np.int32(GAP)
            np.maximum(score[:, 1:], step, out=score[:, 1:])
            np.maximum(score, 0, out=score)
            # Gaps along the passage: a running maximum of score plus distance.
            score += slope
            np.maximum.accumulate(score, axis=1, out=score)
            score -= slope
            np.maximum(best, score.max(1), out=best)
        out[some] = best
        at = stop
    return out


def _pairs(h: np.ndarray, distance: int) -> np.ndarray:
    """The hash of each word with the one `distance` words on; the last words have none."""
    return vec.mix(h[:-distance] * U64(0xE7037ED1A0B428DB) + h[distance:] * U64(0xA0761D6478BD642F))


class Items:
    """Items of the benchmark as word hashes, and how many pairs within how many words a copy has at least."""

    def __init__(self, ids: list, texts: list, size: int = SIZE, min_score: float = MIN_SCORE):
        self.ids = ids
        self.words = []
        for _, _, data, offsets in vec.blocks(pa.array([x or "" for x in texts], pa.large_string())):
            h, _, _, at = vec.words(data, offsets, vec.PLAIN_WORD, fold=True)
            self.words += [h[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        n = np.array([len(w) for w in self.words], np.int64)
        least = np.ceil(MATCH * min_score * n - 1e-9).astype(np.int64)
        #: Shorter items are sought as whole sequences, of each length that occurs.
        self.whole = n < size
        self.short = sorted(set(n[self.whole & (n > 0)].tolist()))
        self.need = np.where(self.whole, 1, np.maximum(1, -(-least // 2) - 1))
        self.reach = 3 * n - least


class Seeds:
    """Hashes that seed the items from `first` to `stop`, as sorted arrays: gram, item."""

    def __init__(self, items: Items, first: int, stop: int):
        grams = []
        for i in range(first, stop):
            h = items.words[i]
            grams.append(vec.shingles(h, np.array([0, len(h)]), len(h))[0] if items.whole[i] and len(h) else np.unique(np.concatenate([_pairs(h, 1), _pairs(h, 2)])) if len(h) else h)
        gram = np.concatenate([np.zeros(0, U64), *grams])
        owner = np.repeat(np.arange(first, stop), [len(g) for g in grams])
        order = np.argsort(gram, kind="stable")
        self.gram, self.owner = gram[order], owner[order]
        self.sieve = Sieve(np.unique(self.gram))

    def hits(self, gram: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of each hash that seeds an item."""
        p = self.sieve.places(gram)
        lo, hi = np.searchsorted(self.gram, gram[p], "left"), np.searchsorted(self.gram, gram[p], "right")
        n = hi - lo
        return self.owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(place[p], n)


class Sieve:
    """A bit table over n-gram hashes: most n-grams of a corpus are turned away by one lookup."""

    def __init__(self, grams: np.ndarray):
        self.bits = max(16, int(len(grams)).bit_length() + 5)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(grams >> U64(64 - self.bits)).astype(np.int64)] = True
        self.grams = grams

    def places(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[(h >> U64(64 - self.bits)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return at[:0]
        i = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        return at[self.grams[i] == h[at]]


def _block_grams(h: np.ndarray, at: np.ndarray, row: np.ndarray, short: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, their first words) of a block's pairs, and of its runs of the lengths of short items."""
    for distance in (1, 2):
        if len(h) > distance:
            place = np.flatnonzero(row[:-distance] == row[distance:])
            yield _pairs(h, distance)[place], place
    for length in short:
        g, to = vec.shingles(h, at, length)
        yield g, np.arange(len(g)) + np.repeat(at[:-1] - to[:-1], np.diff(to))


def _align(key: str, items: Broadcast, min_score: float, min_words: int):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        slices = [Seeds(own, x, min(x + SLICE, len(own.words))) for x in range(0, len(own.words), SLICE)]
        names = [key, "item", "score", "matched_words", "first_word", "end_word", "n_seeds"]
        for batch in batches:
            keys = batch.column(0)
            rows: list[tuple] = []
            for a, b, data, offsets in vec.blocks(batch.column(1)):
                h, _, _, at = vec.words(data, offsets, vec.PLAIN_WORD, fold=True)
                row = np.repeat(np.arange(b - a), np.diff(at))
                grams = list(_block_grams(h, at, row, own.short))
                for seeds in slices:
                    found = [seeds.hits(g, place) for g, place in grams]
                    # One number a hit, in order of item and place; a place tells its row.
                    hits = np.unique(np.concatenate([np.zeros(0, np.int64), *(i * len(h) + w for i, w in found)]))
                    if not len(hits):
                        continue
                    i, w = hits // len(h), hits % len(h)
                    last = np.arange(len(hits)) + own.need[i] - 1
                    end = np.minimum(last, len(hits) - 1)
                    dense = np.flatnonzero((last < len(hits)) & (i[end] == i) & (row[w[end]] == row[w]) & (w[end] - w < own.reach[i]))
                    if not len(dense):
                        continue
                    i, w = i[dense], w[dense]
                    # An alignment reaches no further than `reach` from the first of its hits; where such parts meet they are one passage.
                    start = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (row[w[1:]] != row[w[:-1]]) | (w[1:] - w[:-1] > 2 * own.reach[i[1:]])])
                    stop = np.r_[start[1:], len(i)]
                    item, r = i[start], row[w[start]]
                    lo_w = np.maximum(at[r], w[start] - own.reach[item]).tolist()
                    hi_w = np.minimum(at[r + 1], w[stop - 1] + own.reach[item] + 1).tolist()
                    item, r = item.tolist(), r.tolist()
                    reached = best_scores([own.words[k] for k in item], [h[x:y] for x, y in zip(lo_w, hi_w, strict=True)])
                    for k, got in enumerate(reached.tolist()):
                        words = own.words[item[k]]
                        score = got / (MATCH * len(words))
                        if score >= min_score and got >= MATCH * min(min_words, len(words)) * min_score:
                            got, a_from, a_to = smith_waterman(words, h[lo_w[k] : hi_w[k]])
                            n_seeds = int(np.searchsorted(hits, item[k] * len(h) + hi_w[k]) - np.searchsorted(hits, item[k] * len(h) + lo_w[k]))
                            rows.append((a + r[k], item[k], score, got // MATCH, lo_w[k] + a_from - int(at[r[k]]), lo_w[k] + a_to - int(at[r[k]]), n_seeds))
            if rows:
                place, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(place)), pa.array(rest[0], pa.int64()), pa.array(rest[1], pa.float64()), *(pa.array(c, pa.int64()) for c in rest[2:])], names=names)
        vec.tidy()

    return align


def _parts(benchmark: DataFrame, item_key: str, item_text: str, size: int, min_score: float) -> Iterator[Items]:
    """The benchmark's items in parts of about BROADCAST_BYTES."""
    bench = benchmark.select(F.col(item_key).alias("item_id"), text_or_empty(item_text).alias("text")).distinct()
    weight = bench.agg(F.coalesce(F.sum(F.octet_length("text") * 4 + 64), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-weight // BROADCAST_BYTES))
    for part in range(parts):
        rows = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield Items([x["item_id"] for x in rows], [x["text"] for x in rows], size, min_score)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = SIZE, min_score: float = MIN_SCORE, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document and item that it holds a copy of: (doc_id, item_id, score, matched_words, first_word, end_word, n_seeds).

    The benchmark is small beside the corpus: its size is checked, and one of
    more than BROADCAST_BYTES is taken in several parts, each a pass of its own.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    found = None
    for items in _parts(benchmark, item_key, item_text, size, min_score):
        shared = spark.sparkContext.broadcast(items)
        hits = docs.select(F.col(key), text_or_empty(text).alias("text")).mapInArrow(_align(key, shared, min_score, min_words), f"{key} {kind}, item long, score double, matched_words long, first_word long, end_word long, n_seeds long")
        names = spark.createDataFrame(list(enumerate(items.ids)), f"item long, item_id {item_kind}")
        named = hits.join(F.broadcast(names), "item").drop("item")
        found = named if found is None else found.union(named)
    best = found.groupBy(key, "item_id").agg(F.max(F.struct("score", "matched_words", "n_seeds", "first_word", "end_word")).alias("b"))
    return best.select(key, "item_id", "b.score", "b.matched_words", "b.first_word", "b.end_word", "b.n_seeds")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = SIZE, min_score: float = MIN_SCORE, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs` that hold no copy of an item; each row is judged by its own text, whatever its id."""

    def without(items: Broadcast):
        align = _align("row", items, min_score, min_words)

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                body = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(batch.schema.get_field_index(text))], names=["row", "text"])
                left = np.ones(len(batch), bool)
                for hits in align(iter([body])):
                    left[hits.column(0).to_numpy()] = False
                yield batch.filter(pa.array(left))

        return drop

    for items in _parts(benchmark, item_key, item_text, size, min_score):
        docs = docs.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(items)), docs.schema)
    return docs
