"""Exact Jaccard self-join of word n-gram sets by PartEnum signatures.

Equal sets form one class. For two sets with a Jaccard index of at least
P percent, the sizes of their symmetric difference is at most
k = (100 - P) * (m1 + m2) / (100 + P). Sizes are dealt into bands; a set is
indexed in its own band and, if larger partners can lie there, in the next.
A band's index cuts the feature domain (the hash range) into first-level
partitions, each into two second-level ones, and enumerates the subsets that
must agree when a first-level partition holds at most one difference: its two
halves. With N second-level partitions in all, similar sets agree in at least
N - k of them; those that are not empty give equal signatures.

From that count follow an exact filter and an exact treatment of skew:

* pairs of sets that share signatures in small groups are counted; a pair is
  verified if its count, plus the frequent signatures that it may share,
  reaches N - k less the partitions empty in both;
* a signature of more than SMALL sets forms no pairs: each of its sets is tied
  to the group's centre, the set with the smallest hash. Ties that carry a good
  part of the needed count are verified along with the pairs, and what they
  link gets one label. From then on a frequent signature matters only if its
  group holds two labels: between sets of one label no link is missing;
* a set is hard if the frequent signatures of groups with several labels could
  still hide a partner. Pairs of two hard sets are found on another exact way:
  a prefix filter over their features, rarest first, whose groups with several
  labels are compared with one central member first and then, between
  components that are still apart, tile by tile.

Candidates are verified on the sets themselves. Nothing is capped or sampled.

Defined cases: a null text, and one without words, has an empty set, which
links with nothing; a text with fewer than `size` words has its whole sequence
as its only feature; repeated rows and copies share a class; rows with a null
doc_id take part, and a class of such rows alone has a null component; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vec
from .common import bucket, discard, if_small, keep, pieces, text_or_empty
from .components import components

SIZE, PERCENT = 5, 75
#: Second-level partitions of a band, as a share of the largest difference that must be tolerated.
SPREAD = 1.25
#: Sets that share a signature are paired up to this number; larger groups are dealt with as the docstring says.
SMALL = 16
#: Signatures in one bucket of the shuffle, and those that a task holds before it hands them on.
BUCKET_SIGNATURES, FLUSH_SIGNATURES = 1_500_000, 1_500_000
VERIFY_PAIRS = 2000
TILE_NODES = 1500
U64 = np.uint64


class Bands:
    """Size bands and their numbers of partitions for a similarity of `percent`."""

    def __init__(self, percent: int = PERCENT, largest: int = 1 << 40):
        self.percent = percent
        low, high = [], []
        at = 1
        while at <= largest:
            low.append(at)
            high.append(self.partner(self.partner(at)))
            at = high[-1] + 1
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)
        worst = (100 - percent) * 2 * self.high // (100 + percent)
        self.parts = 2 * np.ceil(SPREAD * (worst + 1) / 2).astype(np.int64)

    def partner(self, m):
        """The largest size that a partner of a set of m can have."""
        return m * 100 // self.percent

    def of(self, m: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, m, "right") - 1


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in vec.blocks(column):
        h, _, _, at = vec.words(data, offsets)
        values, to = vec.distinct_sorted(*vec.shingles(h, at, size))
        yield a, b, values, to


def _signatures(values: np.ndarray, to: np.ndarray, rows: np.ndarray, band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of `rows` in the index of `band`: (signature, row) and the number of partitions that are not empty, by row."""
    n = (to[rows + 1] - to[rows]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), n)
    first = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(n, out=first[1:])
    v = values[np.repeat(to[rows] - first[:-1], n) + np.arange(first[-1])]
    # A set's values are sorted, so the partitions, which are ranges of the hash domain, are runs of it.
    part = ((v >> U64(32)) * bands.parts[band].astype(U64)[owner]) >> U64(32)
    fresh = np.ones(len(v), bool)
    fresh[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(fresh)
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    sums = np.add.reduceat(vec.mix(v), start)
    who = owner[start]
    sig = vec.mix(sums + part[start] * U64(0x9E3779B97F4A7C15) + band[who].astype(U64) * U64(0xD1B54A32D192ED03))
    return sig, who, np.bincount(who, minlength=len(rows))


def classes(docs: DataFrame, key: str, text: str, size: int, bands: Bands) -> DataFrame:
    """(key, n_shingles, node, band, empty0, empty1) per row: its class and the empty partitions of its two indexes."""
    kind = docs.schema[key].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, to in _sets(batch.column(1), size):
                n = np.diff(to)
                band = bands.of(np.maximum(n, 1))
                some = np.flatnonzero(n)
                empty = []
                for step in (0, 1):
                    e = np.zeros(len(n), np.int64)
                    e[some] = bands.parts[band[some] + step] - _signatures(values, to, some, band[some] + step, bands)[2]
                    empty.append(e)
                node = vec.set_hash(values, to).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(node, mask=n == 0), pa.array(band.astype(np.int32)), pa.array(empty[0].astype(np.int32)), pa.array(empty[1].astype(np.int32))],
                    names=[key, "n_shingles", "node", "band", "empty0", "empty1"],
                )
        vec.tidy()

    return docs.select(key, text_or_empty(text).alias("text")).mapInArrow(build, f"{key} {kind}, n_shingles long, node long, band int, empty0 int, empty1 int")


class Line:
    """Where a signature is dealt: bands lie one after another on a line, each as long as it has signatures, cut into buckets of equal length.

    A band's sets meet in few buckets, so a set's own numbers are sent few times.
    """

    def __init__(self, expected: dict[int, int], n_bands: int, size: int):
        self.length = np.array([expected.get(b, 0) for b in range(n_bands)], float)
        self.start = np.r_[0.0, np.cumsum(self.length)]
        self.size = size
        self.buckets = int(self.start[-1] // size) + 1

    def bucket(self, sig: np.ndarray, band: np.ndarray) -> np.ndarray:
        share = (sig & U64(0xFFFFFF)).astype(float) / (1 << 24)
        return ((self.start[band] + share * self.length[band]) // self.size).astype(np.int64)


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 up, as the narrowest of three types, named in front."""
    top = int(x.max()) if len(x) else 0
    kind = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([kind]) + x.astype(f"<u{kind}").tobytes()


def _from_small(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


DEALT = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("steps", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("empties", pa.binary())])


def _deal(size: int, bands: Bands, line: Line):
    """Signatures of all sets, as packed columns by bucket: 4 bytes of hash each and, by set, its hash, size, and empty partitions.

    Signatures stand in the order of their sets; `steps` says how many sets further the next one's set is. A set
    counts twice if it stands in two indexes; `empties` holds twice the empty partitions, plus 1 in the upper index.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, ...]] = []
        n_sigs = known = 0

        def flush() -> pa.RecordBatch:
            sig, owner, to = (np.concatenate([x[i] for x in held]) for i in range(3))
            node, many, empty = (np.concatenate([x[i] for x in held]) for i in range(3, 6))
            order = np.argsort(to, kind="stable")
            sig, owner, to = sig[order], owner[order], to[order]
            start = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            stop = np.r_[start[1:], len(to)]
            out: list[list] = [[] for _ in DEALT]
            for a, b in zip(start.tolist(), stop.tolist(), strict=True):
                mine, place = np.unique(owner[a:b], return_inverse=True)
                row = (int(to[a]), (sig[a:b] >> U64(32)).astype("<u4").tobytes(), _small(np.diff(place, prepend=0)), node[mine].tobytes(), _small(many[mine]), _small(empty[mine]))
                for x, y in zip(out, row, strict=True):
                    x.append(y)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, DEALT, strict=True)], schema=DEALT)

        for batch in batches:
            for _, _, values, to in _sets(batch.column(0), size):
                node = vec.set_hash(values, to).view(np.int64)
                n = np.diff(to)
                _, rows = np.unique(node, return_index=True)
                rows = rows[(n[rows] > 0) & ~np.isin(node[rows], seen, assume_unique=True)]
                # Copies within a task are dealt once.
                seen = np.union1d(seen, node[rows])
                band = bands.of(n[rows])
                more = bands.partner(n[rows]) > bands.high[band]
                for step, r, c in ((0, rows, band), (1, rows[more], band[more] + 1)):
                    sig, who, full = _signatures(values, to, r, c, bands)
                    held.append((sig, known + who, line.bucket(sig, c[who]), node[r], n[r], 2 * (bands.parts[c] - full) + step))
                    known += len(r)
                    n_sigs += len(sig)
                if n_sigs >= FLUSH_SIGNATURES:
                    yield flush()
                    held.clear()
                    n_sigs = known = 0
        if n_sigs:
            yield flush()
        held.clear()
        vec.tidy()

    return deal


MET = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("band", pa.int32()), ("members", pa.int32()), ("n", pa.int32()), ("near", pa.bool_()), ("need", pa.int32())])


def _meet(bands: Bands, table: pa.Table) -> pa.Table:
    """Of one bucket: pairs of sets in small groups (`members` 0) with the number of their common signatures, and ties of sets to the centre v of frequent ones.

    Sets whose sizes alone keep them apart form no pair, and a pair counts in
    one index only, that of the larger set's band; ties say in `near` whether
    the same holds for them. `members` is the size of a frequent group as a
    power of two. `need` is the number of common signatures that the pair must
    have in all.
    """
    percent = bands.percent
    parts = []
    for four, steps, nodes, sizes, empties in zip(*(table.column(i).to_pylist() for i in range(1, 6)), strict=True):
        place = np.cumsum(_from_small(steps))
        twice = _from_small(empties)
        parts.append((np.frombuffer(four, "<u4"), *(x[place] for x in (np.frombuffer(nodes, np.int64), _from_small(sizes).astype(np.int32), (twice >> 1).astype(np.int32), (twice & 1).astype(np.int8)))))
    sig, node, size, empty, upper = (np.concatenate([x[i] for x in parts]) for i in range(5))
    del parts
    order = np.argsort(sig)
    sig = sig[order]
    same = sig[1:] == sig[:-1]
    twice = np.r_[same, False] | np.r_[False, same]
    sig, order = sig[twice], order[twice]
    order = order[np.lexsort((node[order], sig))]
    sig, node, size, empty, upper = np.sort(sig), node[order], size[order].astype(np.int64), empty[order].astype(np.int64), upper[order]
    if len(sig):
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]) | (upper[1:] != upper[:-1])]
        sig, node, size, empty, upper = (x[fresh] for x in (sig, node, size, empty, upper))
    start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    count = np.diff(np.r_[start, len(sig)])
    own = bands.of(size)
    band = (own + upper).astype(np.int32)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])) & (np.maximum(own[i], own[j]) == band[i]) & (band[i] == band[j]) & (node[i] != node[j])

    def rows(i: np.ndarray, j: np.ndarray, members: np.ndarray, ok: np.ndarray) -> pa.Table:
        need = bands.parts[band[i]] - (100 - percent) * (size[i] + size[j]) // (100 + percent) - np.minimum(empty[i], empty[j])
        key = (node[i], node[j], band[i], members)
        order = np.lexsort(key)
        at = np.ones(len(order), bool)
        at[1:] = np.any([x[order][1:] != x[order][:-1] for x in key], axis=0)
        at = np.flatnonzero(at)
        first = order[at]
        n = np.diff(np.r_[at, len(order)])
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((*(x[first] for x in key), n, ok[first], need[first]), MET, strict=True)], schema=MET)

    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, SMALL + 1):
        at = start[count == n]
        if len(at):
            i, j = np.triu_indices(n, 1)
            i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            ok = near(i, j)
            us.append(i[ok])
            vs.append(j[ok])
    i, j = np.concatenate(us), np.concatenate(vs)
    pairs = rows(i, j, np.zeros(len(i), np.int32), np.ones(len(i), bool))
    size_of = np.repeat(count, count)
    hot = np.flatnonzero(size_of > SMALL)
    centre = np.repeat(start, count)[hot]
    ties = rows(hot, centre, np.log2(size_of[hot]).astype(np.int32), near(hot, centre))
    return pa.concat_tables([pairs, ties])


def _meeting(bands: Bands):
    def meet(table: pa.Table) -> pa.Table:
        out = _meet(bands, table)
        vec.tidy()
        return out

    return meet


def _set_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, values, to in _sets(batch.column(0), size):
                some = np.flatnonzero(np.diff(to))
                yield pa.RecordBatch.from_arrays([pa.array(vec.set_hash(values, to).view(np.int64)[some]), pa.array([values[to[i] : to[i + 1]].tobytes() for i in some.tolist()], pa.binary())], names=["node", "features"])
        vec.tidy()

    return rows


def _verify(percent: int):
    def verify(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        own = {n: np.frombuffer(f, U64) for n, f in zip(sets["node"].to_pylist(), sets["features"].to_pylist(), strict=True)}
        good = []
        for u, v in zip(pairs["u"].to_pylist(), pairs["v"].to_pylist(), strict=True):
            a, b = own[u], own[v]
            if len(a) > len(b):
                a, b = b, a
            common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            if 100 * common >= percent * (len(a) + len(b) - common):
                good.append((u, v))
        return pa.table({"u": pa.array([x[0] for x in good], pa.int64()), "v": pa.array([x[1] for x in good], pa.int64())})

    return verify


def links_among(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar.

    Pairs whose sets have the same lowest neighbour meet in one task, so that a set is sent to few; where more than
    VERIFY_PAIRS have it, they are cut by a hash of the first set.
    """
    near = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).union(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))
    low = near.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("low"))
    side = lambda x: low.select(F.col("x").alias(x), F.col("low").alias(f"low_{x}"))
    placed = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").select("u", "v", F.least("low_u", "low_v").alias("c"))
    many = placed.groupBy("c").agg(F.ceil(F.count("*") / VERIFY_PAIRS).cast("int").alias("cut")).filter("cut > 1")
    part = F.pmod(F.xxhash64("u"), F.coalesce("cut", F.lit(1)))
    placed = keep(placed.join(many, "c", "left").select("u", "v", bucket(pieces(pairs.count(), VERIFY_PAIRS), "c", part).alias("block")), "placed")
    each = placed.select("block", F.explode(F.array("u", "v")).alias("node")).distinct()
    with_sets = each.join(sets, "node").select("block", "node", "features")
    left = placed.select(F.col("block").alias("b"), "u", "v")
    return keep(left.groupBy("b").cogroup(with_sets.groupBy("block")).applyInArrow(_verify(percent), "u long, v long"), "links")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, features in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = np.frombuffer(features, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), node)), pa.array(np.full(len(h), len(h)))], names=["h", "node", "n"])


def _tile(percent: int):
    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        """Links between the nodes of both sides with different labels, one for each node on the left and label on the right."""
        sets = [np.frombuffer(f, U64) for f in right["features"].to_pylist()]
        nodes, labels, sizes = right["node"].to_numpy(), right["label"].to_numpy(), np.array([len(s) for s in sets], np.int64)
        us, vs = [], []
        if sets:
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for u, label, features in zip(left["node"].to_pylist(), left["label"].to_pylist(), left["features"].to_pylist(), strict=True):
                a = np.frombuffer(features, U64)
                lo, hi = np.searchsorted(values, a, "left"), np.searchsorted(values, a, "right")
                n = hi - lo
                at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(sets))
                hits = np.flatnonzero((100 * common >= percent * (sizes + len(a) - common)) & (labels != label))
                _, once = np.unique(labels[hits], return_index=True)
                us += [u] * len(once)
                vs += nodes[hits[once]].tolist()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return tile


class _Hard:
    """Pairs of hard sets with different labels: prefix groups over their features, rarest first."""

    def __init__(self, sets: DataFrame, labels: DataFrame, percent: int):
        self.percent = percent
        tokens = keep(sets.mapInArrow(_explode, "h long, node long, n long"), "tokens")
        shared = tokens.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
        known = tokens.join(shared, "h")
        w = Window.partitionBy("node")
        lone = F.col("n") - F.count("*").over(w)
        # Of n features, ceil(P * n / 100) must be common: one of the rarest n - that + 1 is.
        prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        ranked = known.withColumn("lone", lone).withColumn("at", F.row_number().over(w.orderBy("df", "h")))
        prefix = ranked.filter(F.col("at") + F.col("lone") <= prefix).select("h", "node", "n", "lone")
        prefix = prefix.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        self.prefix = keep(prefix, "prefix")
        discard(tokens)

    def star(self) -> DataFrame:
        """(u, v, nu, nv, lone): every member of a group of several labels with the group's most central one."""
        centre = self.prefix.groupBy("h").agg(F.min(F.struct("lone", "node", "n")).alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
        near = self.prefix.join(centre.select("h", "c"), "h").filter("node != c.node")
        return keep(near.select(F.col("node").alias("u"), F.col("c.node").alias("v"), F.col("n").alias("nu"), F.col("c.n").alias("nv"), (F.col("lone") + F.col("c.lone")).alias("lone")).distinct(), "star")

    def rest(self, star: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between components that are still apart within a cluster of overlapping groups."""
        cluster = components(star.select("u", "v"))
        nodes = star.select(F.col("u").alias("node")).union(star.select(F.col("v").alias("node"))).distinct()
        nodes = nodes.join(cluster.withColumnRenamed("label", "cluster"), "node", "left").join(labels, "node", "left")
        nodes = keep(nodes.select("node", F.coalesce("cluster", "node").alias("cluster"), F.coalesce("label", "node").alias("label")), "cluster")
        by_label = nodes.groupBy("cluster", "label").agg(F.count("*").alias("n"))
        main = by_label.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("labels")).filter("labels > 1")
        main = main.select("cluster", F.col("m.label").alias("main"), F.ceil(F.col("all") / TILE_NODES).cast("int").alias("right"), F.ceil((F.col("all") - F.col("m.n")) / TILE_NODES).cast("int").alias("left"))
        placed = nodes.join(main, "cluster").join(sets, "node")
        mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        left = placed.filter("label != main").select(F.col("cluster").alias("ck"), mine("left").alias("ak"), F.explode(F.sequence(F.lit(0), F.col("right") - 1)).alias("bk"), *(F.col(c).alias(c) for c in ("node", "label", "features")))
        right = placed.select("cluster", F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("a"), mine("right").alias("b"), "node", "label", "features")
        return left.groupBy("ck", "ak", "bk").cogroup(right.groupBy("cluster", "a", "b")).applyInArrow(_tile(self.percent), "u long, v long")


def _difference(a: Column, b: Column, percent: int) -> Column:
    """The largest symmetric difference of similar sets of these sizes."""
    return F.floor((100 - percent) * (a + b) / (100 + percent))


def _features(docs: DataFrame, key: str, text: str, size: int, need: DataFrame, info: DataFrame) -> DataFrame:
    """(node, features) of the needed sets, each from the text of one row."""
    need = keep(need.distinct().join(info.select("node", "rep"), "node"), "need")
    n = need.count()
    wanted = if_small(need.select(F.col("rep").alias("_rep")).distinct(), 16, n)
    named = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("text"))
    texts = named.join(wanted, F.col("_key").eqNullSafe(F.col("_rep")), "left_semi").select("text")
    sets = texts.mapInArrow(_set_rows(size), "node long, features binary").join(if_small(need.select("node"), 16, n), "node", "left_semi")
    return keep(sets.dropDuplicates(["node"]), "sets")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) for every row of `docs`."""
    bands = Bands(percent)
    thin = keep(classes(docs, key, text, size, bands), "classes")
    info = keep(thin.filter("node is not null").groupBy("node").agg(F.min(key).alias("rep"), F.first("n_shingles").alias("m"), F.first("band").alias("own"), F.first("empty0").alias("empty0"), F.first("empty1").alias("empty1")), "info")

    # Two rows a set: what it has in each of its two indexes.
    partner = F.floor(F.col("m") * 100 / percent)
    parts = F.array(*(F.lit(int(x)) for x in bands.parts))
    highs = F.array(*(F.lit(int(x)) for x in bands.high))
    index = info.select("node", "m", F.explode(F.array(F.struct(F.col("own").alias("band"), F.col("empty0").alias("empty"), F.lit(True).alias("used")), F.struct((F.col("own") + 1).alias("band"), F.col("empty1").alias("empty"), (partner > F.get(highs, F.col("own"))).alias("used")))).alias("i")).filter("i.used")
    index = index.select("node", "m", F.col("i.band").alias("band"), F.col("i.empty").alias("empty"), F.get(parts, F.col("i.band")).alias("parts"))
    # One number a band; there are as many bands as the logarithm of the largest set.
    expected = {r["band"]: r["n"] for r in index.groupBy("band").agg(F.sum(F.col("parts") - F.col("empty")).alias("n")).collect()}
    line = Line(expected, len(bands.parts), BUCKET_SIGNATURES)

    body = docs.select(text_or_empty(text).alias("text"))
    dealt = body.mapInArrow(_deal(size, bands, line), "bucket int, sigs binary, steps binary, nodes binary, sizes binary, empties binary")
    met = keep(dealt.groupBy("bucket").applyInArrow(_meeting(bands), "u long, v long, band int, members int, n int, near boolean, need int"), "met")
    by_tie = [F.sum("n").alias("n"), F.first("near").alias("near"), F.first("need").alias("need")]
    ties = keep(met.filter("members > 0").groupBy("u", "v", "band", "members").agg(*by_tie), "ties")
    pairs = keep(met.filter("members = 0").groupBy("u", "v", "band").agg(F.sum("n").alias("n"), F.first("need").alias("need")), "counted")
    discard(met)

    # First what counts alone decide, and ties that carry a good part of what is needed.
    tied = ties.filter("near").groupBy("u", "v", "band").agg(F.sum("n").alias("n"), F.first("need").alias("need")).filter("2 * n >= need")
    first = keep(pairs.filter("n >= need").select("u", "v").union(tied.select("u", "v")).distinct(), "pairs")
    sets = _features(docs, key, text, size, first.select(F.explode(F.array("u", "v")).alias("node")), info)
    links = links_among(first, sets, percent)
    labels = components(links)
    discard(sets)

    # Frequent signatures whose groups hold several labels may hide more.
    named = ties.join(labels.withColumnRenamed("node", "u").withColumnRenamed("label", "lu"), "u", "left").join(labels.withColumnRenamed("node", "v").withColumnRenamed("label", "lv"), "v", "left")
    named = named.select("u", "v", "band", "members", "n", (F.coalesce("lu", "u") != F.coalesce("lv", "v")).alias("apart"))
    mixed = named.filter("apart").select("v", "band", "members").distinct()
    hot = keep(named.join(mixed, ["v", "band", "members"], "left_semi").groupBy(F.col("u").alias("node"), "band").agg(F.sum("n").alias("hot")), "hot")
    least = F.col("parts") - _difference(F.col("m"), partner, percent) - F.col("empty")
    hard = keep(index.join(hot, ["node", "band"], "left").filter(least - F.coalesce("hot", F.lit(0)) <= 0).select("node").distinct(), "hard")
    few = pairs.filter("n < need")
    for side in ("u", "v"):
        few = few.join(hot.select(F.col("node").alias(side), "band", F.col("hot").alias(f"hot_{side}")), [side, "band"])
        few = few.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), side, "left")
    few = few.filter((F.col("n") + F.least("hot_u", "hot_v") >= F.col("need")) & (F.coalesce("label_u", "u") != F.coalesce("label_v", "v")))
    few = keep(few.select("u", "v").distinct(), "few")
    more = hard.union(few.select(F.explode(F.array("u", "v")).alias("node")))
    if more.limit(1).count():
        sets = _features(docs, key, text, size, more, info)
        side = _Hard(sets.join(hard, "node", "left_semi"), labels, percent)
        star = side.star()
        lone_ok = F.col("lone") <= _difference(F.col("nu"), F.col("nv"), percent)
        tried = star.filter(lone_ok & (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))).select("u", "v")
        found = links_among(keep(few.union(tried).distinct(), "pairs"), sets, percent)
        labels = components(links.union(found))
        if star.limit(1).count():
            last = keep(side.rest(star, labels, sets), "links")
            if last.limit(1).count():
                labels = components(links.union(found).union(last))
        discard(sets, star, side.prefix)

    named = info.select("node", "rep").join(labels, "node", "left").withColumn("root", F.coalesce("label", "node"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "root").select("node", "component_id")
    empty = thin.filter("node is null").select(key, "n_shingles", F.col(key).alias("component_id"))
    return thin.filter("node is not null").join(named, "node").select(key, "n_shingles", "component_id").union(empty)
