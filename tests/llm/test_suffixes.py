"""Repeated passages against plain counts of all strings."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from optrace.llm import suffixes


def plain(texts, length):
    data = [(x or "").encode() for x in texts]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, y in enumerate(gone) if y and (i == 0 or not gone[i - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(bytes(y for y, z in zip(x, gone) if not z)).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(11)
    word = lambda: "".join(pick.choice("abcdeé日") for _ in range(pick.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (8, 20, 40, 41, 60, 200)]
    texts = [None, "", "short", "a" * 700, "ab" * 300, "x" + "a" * 450, passages[5], passages[5], passages[5][1:], passages[4] + passages[4]]
    for _ in range(150):
        parts = [pick.choice(passages) if pick.random() < 0.4 else text(pick.randrange(5, 60)) for _ in range(pick.randrange(1, 6))]
        one = " ".join(parts)
        texts.append(one)
        if pick.random() < 0.3:
            at = pick.randrange(len(one))
            texts.append(one[:at] + "#" + one[at + 1 :])
    return [(i, x) for i, x in enumerate(texts)] + [(7, passages[5]), (None, text(50)), (None, passages[2])]


def digests(found):
    return sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found.collect()), key=str)


@pytest.mark.parametrize("length,hot,size", [(200, 4096, 4_000_000), (200, 3, 5000), (50, 20, 9000), (20, 10**9, 3000), (200, 0, 20000)])
def test_rows_are_those_of_plain_counts(spark, rows, length, hot, size):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, gram string, block int").repartition(3)
    wanted = sorted([(i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows], length))], key=str)
    assert digests(suffixes.without_repeats(table, length, hot, size)) == wanted


@pytest.mark.parametrize("hot", [4096, 5])
def test_groups_hold_all_occurrences(spark, rows, hot):
    texts = {i: (t or "").encode() for i, t in rows[:120]}
    table = spark.createDataFrame(list(rows[:120]), "doc_id long, text string").repartition(3)
    groups, covered = defaultdict(set), defaultdict(set)
    for x in suffixes.repeat_groups(table, 60, hot, 8000).collect():
        groups[x.group_id].add((x.doc_id, x.start, x.length))
        covered[x.doc_id].update(range(x.start, x.start + x.length))
    for members in groups.values():
        strings = {texts[d][a : a + n] for d, a, n in members}
        assert len(members) > 1 and len(strings) == 1
    whole = {i: len(covered[i]) for i in texts}
    assert whole == {i: x[1] for i, x in zip(texts, plain([t for _, t in rows[:120]], 60))}
    if hot == 4096:  # each group has every place of its string that lies around an equal anchor: all of them
        for members in groups.values():
            string = next(texts[d][a : a + n] for d, a, n in members)
            places = {(d, a, len(string)) for d, t in texts.items() for a in range(len(t)) if t.startswith(string, a)}
            assert members <= places


def test_maximal_repeats_of_small_contexts():
    """Left and right reaches against all subsets that agree around the anchor."""
    pick = random.Random(2)
    for _ in range(200):
        gram = suffixes.gram_length(10)
        lefts = [bytes(pick.choice(b"ab") for _ in range(pick.randrange(0, 5))) for _ in range(pick.randrange(2, 9))]
        rights = [b"x" * gram + bytes(pick.choice(b"ab") for _ in range(pick.randrange(0, 5))) for _ in lefts]
        wanted = set()
        for a in range(5):
            for b in range(gram, gram + 5):
                if a + b >= 10:
                    by = defaultdict(set)
                    for i, (x, y) in enumerate(zip(lefts, rights)):
                        if len(x) >= a and len(y) >= b:
                            by[x[:a], y[:b]].add(i)
                    for some in (s for s in by.values() if len(s) > 1):
                        longer_left = {lefts[i][: a + 1] if len(lefts[i]) > a else None for i in some}
                        longer_right = {rights[i][: b + 1] if len(rights[i]) > b else None for i in some}
                        if (len(longer_left) > 1 or None in longer_left) and (len(longer_right) > 1 or None in longer_right):
                            wanted.add((a, b, frozenset(some)))
        assert {(a, b, frozenset(x)) for a, b, x in suffixes.maximal_repeats(lefts, rights, 10)} == wanted


def test_empty(empty):
    assert suffixes.without_repeats(empty).count() == 0
    assert suffixes.repeat_groups(empty).count() == 0
