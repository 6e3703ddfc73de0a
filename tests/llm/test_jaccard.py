from __future__ import annotations

import random
import re

import numpy as np

from lodestar.llm import jaccard_join, vec


def shingle_set(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows: list[tuple]) -> dict:
    """component of each row, by comparing all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in index[x] if j < i}:
            common = len(s & sets[j])
            if 100 * common >= 75 * (len(s) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    lowest: dict = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            lowest[r] = d if r not in lowest else min(lowest[r], d)
    return sorted(((d, len(sets[i]), lowest.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def compare(spark, rows):
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"q{rng.randrange(10**6)}"
    return out


def test_near_copies_common_passages_and_hot_groups(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, passage, base = [], [word() for _ in range(40)], [word() for _ in range(150)]
    for i in range(120):  # one large group of near copies, light and heavy edits
        rows.append((1000 + i, " ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 5, 8, 12])))))
    for i in range(80):  # unrelated texts that share most of a short passage
        own = [word() for _ in range(rng.choice([3, 8, 30, 100]))]
        rows.append((2000 + i, " ".join(own + passage)))
    for i in range(60):  # pairs and chains of all sizes
        t = [word() for _ in range(rng.randint(1, 60))]
        for k in range(3):
            rows.append((3000 + 10 * i + k, " ".join(t).upper() if k == 1 else " ".join(t)))
            t = edited(rng, t, 1)
    compare(spark, rows)


def test_small_sets_at_the_threshold(spark):
    rows = [(i, " ".join(f"t{j}" for j in range(a, b))) for i, (a, b) in enumerate([(0, 8), (0, 7), (0, 9), (1, 9), (2, 9), (0, 5), (0, 6), (0, 4), (0, 4), (0, 3), (20, 27), (20, 28), (21, 28), (20, 26)])]
    compare(spark, rows)


def test_edges(spark, edge_docs, no_docs):
    got = jaccard_join.join(edge_docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)
    assert jaccard_join.join(no_docs).count() == 0


def test_bands_admit_every_partner():
    b = jaccard_join.Bands(75, 5000)
    for m in range(1, 2000):
        own = int(b.of(np.array([m]))[0])
        top = int(b.of(np.array([b.partner(m)]))[0])
        assert top - own in (0, 1)


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = ["", "A b\tc\x0bd\x0ce\rf\ng  ", "É é x y", " lead", "one"]
    for _, _, data, offsets in vec.blocks(pa.array(texts)):
        _, starts, ends, at = vec.words(data, offsets)
        for i, t in enumerate(texts):
            raw = t.encode()
            got = [raw[s - offsets[i] : e - offsets[i]].decode() for s, e in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], strict=True)]
            assert got == re.findall(r"[^\x20\x09-\x0D]+", t)


def test_forest_names_the_smallest_node_of_each_component():
    from lodestar.llm.components import forest

    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    root = {int(x): int(x) for x in np.r_[u, v]}
    for _ in range(300):
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            root[a] = root[b] = min(root[a], root[b])
    node, low = forest(u, v)
    assert dict(zip(node.tolist(), low.tolist(), strict=True)) == {k: r for k, r in root.items() if k != r}
