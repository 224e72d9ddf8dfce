import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from optrace.llm import jaccard
from optrace.llm.common import components


def plain_sets(rows):
    out = []
    for doc_id, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        out.append((doc_id, {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()))
    return out


def brute_force(rows):
    """(doc_id, set size, component, links) of every row, from all pairs."""
    sets = plain_sets(rows)
    parent, links = list(range(len(sets))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            parent[root(i)] = root(j)
            links[i] += 1
            links[j] += 1
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(s), least.get(root(i)), links[i]) for i, (d, s) in enumerate(sets)), key=str)


def found(frame, **more):
    return sorted((tuple(x) for x in jaccard.jaccard_components(frame, **more).collect()), key=str)


def test_against_all_pairs(documents):
    rows = [(x.doc_id, x.text) for x in documents.collect()]
    assert found(documents) == brute_force(rows)


def test_blocks_smaller_than_a_cluster(spark):
    pick = random.Random(1)
    base = [str(pick.random()) for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(pick.choice([0, 1, 2, 4, 6])):
            words[pick.randrange(len(words))] = str(pick.random())
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(frame, block=2000) == brute_force(rows) == found(frame)


def test_many_short_texts_in_one_cluster(spark, monkeypatch):
    """Blocks are bounded by rows as well as by shingles; the links are those of one block."""
    base = [f"w{i}" for i in range(45)]
    rows = [(i, " ".join([*base[:i % 45], f"x{i}", *base[i % 45 + 1 :]][: 44 + i % 2])) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want, sizes, counted = brute_force(rows), [], jaccard._counts
    assert max(x[3] for x in want) > 10
    assert found(frame, block_rows=32) == want == found(frame)
    monkeypatch.setattr(jaccard, "STRIP", 7)
    sets = [(f"n{i:03}", i % 2, 1, jaccard.shingles(t)) for i, t in rows]
    monkeypatch.setattr(jaccard, "_counts", lambda x: sizes.append(len(x)) or counted(x))
    inside = [jaccard._linked((k, k), [x for x in sets if x[1] == k], 85) for k in (0, 1)]
    links = Counter()
    for node, _, n in [*inside[0], *inside[1], *jaccard._linked((0, 1), sets, 85)]:
        links[node] += n
    assert sizes == [150, 150, 300] and [links[f"n{i:03}"] for i, *_ in rows] == [x[3] for x in sorted(want)]


def test_empty_table(empty):
    assert found(empty) == []


def test_one_of_each(documents):
    kept = jaccard.one_of_each(documents)
    assert kept.columns == documents.columns
    groups = {(d, n): c for d, n, c, _ in brute_force([(x.doc_id, x.text) for x in documents.collect()])}
    ids = [x.doc_id for x in kept.collect() if x.doc_id is not None]
    assert {c for c in groups.values() if c is not None} <= set(ids)


@pytest.mark.parametrize("size", [2, 3, 6, 7, 8, 12, 13, 14, 20, 40, 90, 200, 333, 700])
def test_linked_sets_share_signatures(size):
    """Any two sets of the largest difference that still links share as many signatures as needed."""
    pick = np.random.default_rng(size)
    for _ in range(60):
        pool = pick.integers(0, 2**63, 3 * size).astype(np.uint64)
        a = np.unique(pool[:size])
        drop = int(pick.integers(0, max(1, size * 15 // 100 + 1)))
        add = 0
        while 100 * (size - drop) >= 85 * (size + add + 1):
            add += 1
        if 100 * (size - drop) < 85 * (size + add):
            continue
        add = int(pick.integers(0, add + 1))
        b = np.unique(np.concatenate([a[drop:], pool[size : size + add]]))
        if len(b) == size and (a == b).all():
            continue
        shared = False
        for one in jaccard.plans(len(a)):
            for two in jaccard.plans(len(b)):
                if one[:3] == two[:3]:
                    x, need_x = jaccard.signatures(a, *one)
                    y, need_y = jaccard.signatures(b, *two)
                    both = len(np.intersect1d(x, y))
                    shared |= both >= max(need_x, need_y)
        assert shared, (len(a), len(b))


def test_components(spark):
    pick = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(pick.randrange(100, 300), pick.randrange(100, 300)) for _ in range(150)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    alone = {x for x in parent if all(a == b for a, b in edges if x in (a, b))}
    got = {tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, root(x)) for x in parent if x not in alone}
