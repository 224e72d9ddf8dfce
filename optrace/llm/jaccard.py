"""Operator 10: n-gram Jaccard self-join by PartEnum signatures, with connected components.

A document's set holds its distinct word shingles. Sets fall into size bands; within a band two
sets that link differ in at most k shingles. The shingle domain is partitioned by a hash into R
regions, and a signature is the content of a subset of regions: pairs of regions where k is at
most 2 (R = k + 2), single regions beyond (R a fifth above k + 1). Each differing shingle spoils
one region, so at least R - k regions agree and linked sets share a signature. A set close below
the next band's sizes also takes part in that band with the band's regions.

Regions of one shingle carry little information and are left out as long as the count proves that
a linked set shares others: with T = R - k - (regions left out) > 0 a set without T signatures
that another set has too cannot be linked and is dropped before candidates are joined. Where T is
not positive, every region counts, also the empty ones, and T is 1. So no link is lost.

What is left is linked by common signatures into candidate clusters; a cluster is compared block
against block, with exact intersections, and each block pair gives a spanning forest of its links
rather than the links. Copies with one set are one class throughout."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from optrace.llm.common import components, hashed_words, mixed, mixed_int, slices, staged

WIDTH, PERCENT = 4, 85
#: Shingles on each side of a block pair (a single larger set is a block of its own).
BLOCK = 1_000_000
#: Sets on each side of a block pair, on average, and rows of its matrix worked off at once.
ROWS, STRIP = 2048, 256
#: Columns held by more sets than this are counted by matrix product, others by pairs.
DENSE = 48
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes, ascending; a text of fewer words is one shingle."""
    words = hashed_words((text or "").encode().translate(LOWER).split())
    if not len(words):
        return words
    span = min(width, len(words))
    out = words[: len(words) - span + 1].copy()
    for i in range(1, span):
        out = (out ^ (out >> np.uint64(31))) * STEP + words[i : len(words) - span + 1 + i]
    return np.unique(mixed(out + np.uint64(span)))


def bands(size: int) -> tuple[int, int, int]:
    """(number, least, most) of the size band; each is about half as large again as the one before."""
    number, low = 0, 1
    while True:
        high = low + low // 2
        if size <= high:
            return number, low, high
        number, low = number + 1, high + 1


def _most_different(total: int, percent: int) -> int:
    """Largest symmetric difference of linked sets whose sizes add up to total."""
    return total * (100 - percent) // (100 + percent)


def _regions(k: int) -> int:
    return k + 2 if k <= 2 else k + 1 + -(-(k + 1) // 5)


def plans(size: int, percent: int = PERCENT) -> list[tuple[int, int, int, int]]:
    """(band, R, subset size, k of this set) for each band the set takes part in."""
    number, _, high = bands(size)
    partner = size * 100 // percent
    out = []
    k = _most_different(2 * high, percent)
    out.append((number, _regions(k), 2 if k <= 2 else 1, _most_different(size + min(partner, high), percent)))
    if partner > high:
        top = high + 1 + (high + 1) // 2
        k = _most_different(2 * top, percent)
        out.append((number + 1, _regions(k), 2 if k <= 2 else 1, _most_different(size + min(partner, top), percent)))
    # A set that can differ from none but equal sets needs no signature: equal sets are one class.
    return [x for x in out if x[3] > 0]


def signatures(found: np.ndarray, band: int, regions: int, subset: int, k: int) -> tuple[np.ndarray, int]:
    """Signatures of one set in a band, and how many of them a linked set must share with others."""
    place = ((mixed(found + np.uint64((band + 1) * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(16)) % np.uint64(regions)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    counts = np.bincount(place, minlength=regions)
    values = mixed(found ^ np.uint64(0xA5A5F00D12345678))[order]
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(counts)
    sums = running[ends] - running[ends - counts]
    sums = mixed(sums + np.arange(regions, dtype=np.uint64) * STEP + np.uint64(band))
    agreeing = regions - k
    if subset == 1:
        need = agreeing - int((counts < 2).sum())
        return (sums[counts >= 2], need) if need > 0 else (sums, 1)
    pairs = np.array(list(combinations(range(regions), 2)))
    out = mixed(sums[pairs[:, 0]] * STEP + sums[pairs[:, 1]])
    weak = counts[pairs].sum(axis=1) < 2
    need = agreeing * (agreeing - 1) // 2 - int(weak.sum())
    return (out[~weak], need) if need > 0 else (out, 1)


def digests(found: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set as signed longs; the first one is even."""
    one = int(mixed(found ^ np.uint64(0x1234567890ABCDEF)).sum(dtype=np.uint64))
    two = int(mixed(found + np.uint64(0x0FEDCBA987654321)).sum(dtype=np.uint64))
    return _signed(mixed_int(one) & ~1), _signed(mixed_int(two))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _digest_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    found = shingles(text, width)
                    rows.append((len(found), *digests(found)))
                n, one, two = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                    ["doc_id", "n", "one", "two"],
                )

    return run


def _signature_rows(width: int, percent: int):
    """Rows (sig, spread, key, need): need is what the set must share, 0 where this task knows that
    others share the signature. Of the sets of one slice that share a signature only the first
    goes to the signature's partition; the others are spread by their own key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                found_sigs, keys, needs = [], [], []
                for text in part.column("text").to_pylist():
                    found = shingles(text, width)
                    if not len(found):
                        continue
                    one, _ = digests(found)
                    if one in seen:
                        continue
                    seen.add(one)
                    for role, plan in enumerate(plans(len(found), percent)):
                        sigs, need = signatures(found, *plan)
                        found_sigs.append(sigs)
                        keys.append(np.full(len(sigs), one | role, np.int64))
                        needs.append(np.full(len(sigs), need, np.int32))
                if not found_sigs:
                    continue
                sig, key, need = np.concatenate(found_sigs).view(np.int64), np.concatenate(keys), np.concatenate(needs)
                order = np.argsort(sig, kind="stable")
                sig, key, need = sig[order], key[order], need[order]
                same = sig[1:] == sig[:-1]
                follows = np.concatenate([[False], same])
                shared = follows | np.concatenate([same, [False]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig), pa.array(np.where(follows, key, sig)), pa.array(key), pa.array(np.where(shared, -need, need))],
                    ["sig", "spread", "key", "need"],
                )

    return run


def candidate_clusters(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """(one, cluster) of every set that may have a link; sets of different clusters have none."""
    rows = documents.select("text").mapInArrow(_signature_rows(width, percent), "sig long, spread long, key long, need int")
    same = Window.partitionBy("spread")
    rows = rows.select("*", F.min("key").over(same).alias("low"), F.max("key").over(same).alias("high"))
    active = staged(rows.filter("need < 0 OR low < high").select("sig", "key", F.abs("need").alias("need")), "signatures")
    able = active.groupBy("key").agg(F.count(F.lit(1)).alias("shared"), F.max("need").alias("need")).filter("shared >= need")
    kept = active.join(able.select("key"), "key").select("sig", F.expr("key & -2L").alias("one"))
    first = kept.groupBy("sig").agg(F.min("one").alias("first"), F.max("one").alias("last")).filter("first < last").select("sig", "first")
    edges = kept.join(first, "sig").filter("one <> first").select(F.col("one").alias("a"), F.col("first").alias("b")).distinct()
    return components(edges).select(F.col("node").alias("one"), F.col("component").alias("cluster"))


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keep, features = [], []
                ones, twos = part.column("one").to_pylist(), part.column("two").to_pylist()
                for row, text in enumerate(part.column("text").to_pylist()):
                    found = shingles(text, width)
                    if digests(found) == (ones[row], twos[row]):  # another text may have the same doc_id
                        keep.append(row)
                        features.append(found.tobytes())
                kept = part.take(pa.array(keep, pa.int64()))
                names = ["cluster", "blocks", "node", "copies"]
                yield pa.RecordBatch.from_arrays(
                    [kept.column(x) for x in names] + [pa.array(features, pa.binary())], [*names, "features"]
                )

    return run


def _strips(size: int) -> list[slice]:
    return [slice(at, min(at + STRIP, size)) for at in range(0, size, STRIP)]


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes."""
    size = len(sets)
    owner = np.repeat(np.arange(size), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    times = np.diff(np.concatenate([starts, [len(flat)]]))
    out = np.zeros((size, size), np.float32)
    dense = np.flatnonzero(times > DENSE)
    for at in range(0, len(dense), 1024):
        columns = dense[at : at + 1024]
        matrix = np.zeros((size, len(columns)), np.float32)
        where = np.repeat(np.arange(len(columns)), times[columns])
        inside = np.repeat(starts[columns] - np.concatenate([[0], np.cumsum(times[columns])[:-1]]), times[columns]) + np.arange(len(where))
        matrix[owner[inside], where] = 1
        for rows in _strips(size):
            out[rows] += matrix[rows] @ matrix.T
    flatten = out.reshape(-1)
    for t in np.unique(times[(times > 1) & (times <= DENSE)]):
        group = owner[starts[times == t][:, None] + np.arange(t)]
        a, b = np.triu_indices(t, 1)
        for at in range(0, len(group), 1 + 4_000_000 // len(a)):
            part = group[at : at + 1 + 4_000_000 // len(a)]
            low, high = part[:, a].reshape(-1), part[:, b].reshape(-1)
            place, n = np.unique(np.concatenate([low * size + high, high * size + low]), return_counts=True)
            flatten[place] += n
    return out


def _linked(blocks: tuple[int, int], rows: list[tuple], percent: int) -> list[tuple]:
    """(node, smallest linked node of the forest, links to others) of one pair of blocks."""
    rows = list({x[0]: x for x in rows}.values())
    sets = [x[3] for x in rows]
    both = _counts(sets)
    sizes = np.array([len(x) for x in sets], np.float64)
    strips, side = _strips(len(rows)), np.array([x[1] for x in rows])
    linked = np.zeros(both.shape, bool)
    copies, degree = np.array([x[2] for x in rows], np.float64), np.zeros(len(rows))
    for some in strips:
        linked[some] = 100.0 * both[some] >= percent * (sizes[some, None] + sizes[None, :] - both[some])
        if blocks[0] != blocks[1]:
            linked[some] &= side[some, None] != side[None, :]
    del both
    np.fill_diagonal(linked, False)
    for some in strips:
        degree[some] = linked[some] @ copies
    rank = np.argsort(np.argsort(np.array([x[0] for x in rows])))
    label = rank.astype(np.int64)
    while True:
        other = np.concatenate([np.where(linked[some], label[None, :], len(rows)).min(axis=1, initial=len(rows)) for some in strips])
        new = np.minimum(label, other)
        new = np.minimum(new, new[np.argsort(rank)[new]])
        if (new == label).all():
            break
        label = new
    names = sorted(x[0] for x in rows)
    return [(rows[i][0], names[label[i]], int(degree[i])) for i in range(len(rows)) if degree[i]]


def _block_links(percent: int):
    def groups(batches):
        now, rows = None, []
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("cluster", "i", "j", "node", "block", "copies", "features")]
            for cluster, i, j, node, block, copies, features in zip(*columns):
                if (cluster, i, j) != now:
                    if rows:
                        yield now, rows
                    now, rows = (cluster, i, j), []
                rows.append((node, block, copies, np.frombuffer(features, np.uint64)))
        if rows:
            yield now, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in groups(batches):
            if len(rows) > 1 and (found := _linked((i, j), rows, percent)):
                node, other, links = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), pa.array(links, pa.int64())], ["node", "other", "links"])

    return run


def jaccard_components(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK, block_rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of (doc_id, text).

    Words are runs without ASCII white space, A-Z lower-cased; sets link when
    100 * intersection >= percent * union. component_id is the smallest doc_id reachable by
    links; n_links counts the other rows linked directly, copies included. Null or blank texts
    have an empty set and are linked with nothing. Rows repeated or sharing a doc_id each give a
    row; a row without doc_id has the component_id of rows with an equal set that have one, else null:
    its text is not looked up, so beyond that it links nothing. Other columns are left out."""
    documents = documents.select("doc_id", "text")
    spark_rows = documents.mapInArrow(_digest_rows(width), "doc_id long, n long, one long, two long")
    rows = staged(spark_rows, "sets")
    node = F.concat(F.hex("one"), F.lit("-"), F.hex("two"))
    classes = rows.filter("n > 0").groupBy("one", "two").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = staged(classes.withColumn("node", node), "classes")
    clusters = staged(candidate_clusters(documents, width, percent), "clusters")
    members = staged(classes.join(clusters, "one"), "members")
    blocks = F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.count(F.lit(1)) / block_rows))
    sizes = members.groupBy("cluster").agg(blocks.cast("int").alias("blocks"))
    members = members.filter("doc_id IS NOT NULL").join(sizes, "cluster")
    read = documents.join(members.select("doc_id", "one", "two", "cluster", "blocks", "node", "copies"), "doc_id")
    found = read.select("text", "one", "two", "cluster", "blocks", "node", "copies").mapInArrow(
        _features(width), "cluster long, blocks int, node string, copies long, features binary"
    )
    found = found.withColumn("block", F.pmod(F.hash("node"), "blocks"))
    paired = found.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    paired = paired.select("cluster", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "block", "copies", "features")
    paired = paired.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    links = staged(paired.mapInArrow(_block_links(percent), "node string, other string, links long"), "links")
    parts = components(links.select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("component", "part")
    degrees = links.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = classes.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    least = labelled.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    labelled = staged(labelled.join(least, "part").join(degrees, "node", "left").select(
        "one", "two", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    ), "labelled")
    return rows.join(labelled, ["one", "two"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Rows of documents, one of each component: the row of the smallest doc_id. Rows that repeat a
    doc_id and its text count once; rows without text or words stay, as do rows without doc_id."""
    found = jaccard_components(documents, width, percent).filter("component_id IS NULL OR doc_id IS NULL OR doc_id = component_id")
    kept = found.filter("doc_id IS NOT NULL").select("doc_id").distinct()
    out = documents.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return out.unionByName(documents.filter("doc_id IS NULL"))
