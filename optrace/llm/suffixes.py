"""Operator 13: passages that repeat, from an enhanced suffix array cut into bounded buckets.

Only some suffixes are sorted. Of each window of LENGTH bytes the gram of the least hash (the leftmost of
equals) is its anchor, so equal windows have their anchors at the same place, and a repeated window lies
around an anchor whose gram repeats too. Grams are counted over blocks of documents; anchors of repeated
grams go, with the text of the windows they stand for, to a bucket by gram. There the suffixes that start
at anchors are sorted, neighbours' common prefixes give the enhanced array, and a scan with a stack lists
its common-prefix intervals. The members of an interval are then extended to the left: the tree of their
common left contexts, found by the same scan, tells where left extensions begin to differ. An interval of
both (left reach, right reach) that is LENGTH long and not all inside a longer one is a maximal repeat
among the windows of its anchor, with all its occurrences. A longer repeat comes as one group for each
anchor in it, and their union is the repeat.

A gram of more than HOT occurrences would make a large bucket. Its windows are counted one by one, each
under a digest of its own that a block sends once, so such a group is never gathered."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from optrace.llm.common import mixed, shared_folder, slices, staged

LENGTH, HOT = 200, 4096
#: Bytes of text in a block, windows looked at together, and rows of a bucket on average.
BLOCK, SLAB, ROWS = 4_000_000, 1 << 19, 8000
PLACE = np.uint64((1 << 20) - 1)
BASE = 0x9E3779B97F4A7C15  # any odd number
CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def gram_length(length: int) -> int:
    """Bytes of a gram: long, since a repeated one should seldom be in no repeated window."""
    return max(1, length * 16 // 25)


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(place, left, right, gram) of the anchors of documents that lie one after the other in data,
    starts being their bounds: the windows an anchor stands for cover left bytes before its place and
    right bytes from it on; gram is a hash."""
    gram, ends, out = gram_length(length), starts[1:], []
    wide = length - gram + 1  # grams of a window
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SLAB + length, BASE, np.uint64)]))
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SLAB + length, pow(BASE, -1, 1 << 64), np.uint64)]))
    for at in range(0, max(0, len(data) - length + 1), SLAB):
        part = data[at : at + SLAB + length - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(CODES[part] * powers[: len(part)])])
        hashes = mixed((sums[gram:] - sums[:-gram]) * inverse[: len(sums) - gram])
        least = _sliding_least((hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64), wide)
        window = np.arange(at, at + len(least))
        window = np.flatnonzero(window + length <= ends[np.searchsorted(ends, window, side="right")])
        if len(window):
            place = (least[window] & PLACE).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)]))
            last = np.append(first[1:], len(window)) - 1
            out.append((at + place[first], place[first] - window[first], window[last] + length - place[first], hashes[place[first]].astype(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def _sliding_least(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of every wide neighbours, from running minima of blocks of that width."""
    rows = np.concatenate([values, np.full(-len(values) % wide, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(values) - wide + 1
    return np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n])


BLOCKS = "block long, doc_id array<long>, starts array<int>, data binary, place array<int>, left array<int>, right array<int>, gram array<long>"
CONTEXTS = "bucket long, home long, at array<int>, left int, counted boolean, context binary"
FOUND = "home long, at array<int>, left int, right int, group_id string"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
GROUPS = "group_id string, length long, doc_id long, start long"


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def _blocks(size: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", size):
                texts = [(x or "").encode() for x in part.column("text").to_pylist()]
                data, starts = b"".join(texts), np.cumsum([0, *map(len, texts)])
                lists = [starts, *anchors(np.frombuffer(data, np.uint8), starts, length)]
                cells = [pa.array([number]), pa.ListArray.from_arrays([0, part.num_rows], part.column("doc_id")), pa.array([data], pa.binary())]
                for x, kind in zip(lists, [pa.int32()] * 4 + [pa.int64()]):
                    cells.append(pa.ListArray.from_arrays([0, len(x)], pa.array(x).cast(kind)))
                yield pa.RecordBatch.from_arrays([cells[i] for i in (0, 1, 3, 2, 4, 5, 6, 7)], _names(BLOCKS))
                number += 1

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            grams, n = np.unique(batch.column("gram")[i].values.to_numpy(), return_counts=True)
            out = pa.RecordBatch.from_arrays([pa.repeat(batch.column("block")[i], len(grams)), pa.array(grams), pa.array(n)], ["home", "gram", "n"])
            yield from (out.slice(at, 100_000) for at in range(0, len(grams), 100_000))


def _list(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _contexts(buckets: int, length: int):
    """The texts around a block's anchors of repeated grams, equal ones once; of hot grams a digest of
    each window."""

    def run(block: pa.Table, repeated: pa.Table) -> pa.Table:
        grams = repeated.column("gram").to_numpy()
        order = np.argsort(grams)
        grams, hot = grams[order], repeated.column("hot").to_numpy(zero_copy_only=False)[order]
        out: dict[tuple, list[int]] = defaultdict(list)
        if len(grams):
            data = block.column("data")[0].as_py()
            place, left, right, gram = (_list(block, x) for x in ("place", "left", "right", "gram"))
            found = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            use = np.flatnonzero(grams[found] == gram)
            rows = zip(use.tolist(), place[use].tolist(), left[use].tolist(), right[use].tolist(), (gram[use] % buckets).tolist(), hot[found[use]].tolist())
            for i, at, before, after, bucket, many in rows:
                if many:
                    for d in range(length - after, before + 1):
                        digest = xxhash.xxh3_128_digest(data[at - d : at - d + length])
                        out[int.from_bytes(digest[:6], "little") % buckets, d, True, digest].append(i)
                else:
                    out[bucket, before, False, data[at - before : at + after]].append(i)
        keys = list(zip(*out)) or [(), (), (), ()]
        cells = [pa.array(keys[0], pa.int64()), pa.repeat(block.column("block")[0], len(out)), pa.array(list(out.values()), pa.list_(pa.int32())),
                 pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.bool_()), pa.array(keys[3], pa.binary())]
        return pa.table(cells, _names(CONTEXTS))

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:  # a[:low] == b[:low], a[:high] != b[:high]
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _intervals(texts: list[bytes], order: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of sorted texts, of least bytes or more: a scan with
    a stack over the neighbours' common prefixes. An inner interval comes before those around it."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(order) + 1):
        now = _common(texts[order[i - 1]], texts[order[i]]) if i < len(order) else -1
        first = i - 1
        while stack and now < stack[-1][0]:
            value, first = stack.pop()
            yield value, first, i - 1
        if now >= least and (not stack or now > stack[-1][0]):
            stack.append((now, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members) of the maximal repeats of length bytes or more around anchors. lefts are the
    contexts before the anchors, read backwards; rights those from the anchors on."""
    order = sorted(range(len(rights)), key=rights.__getitem__)
    by_left = {i: n for n, i in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__))} if len(order) > 1 else {}
    rank = {i: n for n, i in enumerate(order)}
    for right, first, last in _intervals(rights, order, gram_length(length)):
        members = sorted(order[first : last + 1], key=by_left.__getitem__)
        for left, one, two in _intervals(lefts, members, max(0, length - right)):
            some = members[one : two + 1]
            places = [rank[i] for i in some]
            if _common(rights[order[min(places)]], rights[order[max(places)]]) == right:  # else found with more to the right
                yield left, right, some


def _found(length: int, groups: bool):
    def run(rows: pa.Table) -> pa.Table:
        """How far each row's anchors are in repeats to the left and right; with groups a row for each
        maximal repeat it is in."""
        out: list[tuple] = []
        homes, ats, lefts, counted, texts = (rows.column(x).to_pylist() for x in ("home", "at", "left", "counted", "context"))
        windows, plain = defaultdict(list), []
        for i, by_window in enumerate(counted):
            windows[texts[i]].append(i) if by_window else plain.append(i)
        for digest, some in windows.items():
            if len(some) > 1 or len(ats[some[0]]) > 1:
                out += [(homes[i], ats[i], lefts[i], length - lefts[i], digest.hex()) for i in some]
        before = [texts[i][: lefts[i]][::-1] for i in plain]
        after = [texts[i][lefts[i] :] for i in plain]
        # Rows of several anchors of one block repeat as they are.
        alone = {n for n, i in enumerate(plain) if len(ats[i]) > 1}
        reach = {n: (len(before[n]), len(after[n])) for n in alone}
        for left, right, members in maximal_repeats(before, after, length):
            if groups:
                n = members[0]
                name = xxhash.xxh3_128_hexdigest(before[n][:left][::-1] + after[n][:right])
                out += [(homes[plain[n]], ats[plain[n]], left, right, name) for n in members]
                alone.difference_update(n for n in members if (left, right) == (len(before[n]), len(after[n])))
            else:
                for n in members:
                    was = reach.get(n, (0, 0))
                    reach[n] = max(left, was[0]), max(right, was[1])
        if groups:
            out += [(homes[plain[n]], ats[plain[n]], *reach[n], xxhash.xxh3_128_hexdigest(texts[plain[n]])) for n in sorted(alone)]
        else:
            out += [(homes[plain[n]], ats[plain[n]], *reach[n], "") for n in sorted(reach)]
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.string()]
        return pa.table([pa.array(x, k) for x, k in zip(list(zip(*out)) or [()] * 5, kinds)], _names(FOUND))

    return run


def _removed(block: pa.Table, found: pa.Table) -> pa.Table:
    """What is left of a block's documents without the ranges found."""
    data, starts, ids = block.column("data")[0].as_py(), _list(block, "starts").astype(np.int64), block.column("doc_id").combine_chunks().flatten()
    begin, end = _ranges(block, found)
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    if len(begin):
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
        document = np.searchsorted(starts, begin, side="right") - 1
        reach = np.maximum.accumulate(end)  # no range leaves its document
        cut = np.flatnonzero(np.concatenate([[True], (begin[1:] > reach[:-1]) | (document[1:] != document[:-1])]))
        for d, a, b in zip(document[cut].tolist(), begin[cut].tolist(), np.maximum.reduceat(end, cut).tolist()):
            spans[d].append((a, b))
    out = []
    for d, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        rest, at = hashlib.sha256(), a
        for one, two in spans[d]:
            rest.update(data[at:one])
            at = two
        rest.update(data[at:b])
        own = [{"start": one - a, "end": two - a} for one, two in spans[d]]
        out.append((b - a, sum(x["end"] - x["start"] for x in own), len(own), rest.hexdigest(), own))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    cells = [pa.array(x, k) for x, k in zip(list(zip(*out)) or [()] * 5, kinds)]
    return pa.table([ids, *cells], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _ranges(block: pa.Table, found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    at = found.column("at").combine_chunks()
    n = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    place = _list(block, "place").astype(np.int64)[at.flatten().to_numpy(zero_copy_only=False)] if len(n) else np.zeros(0, np.int64)
    left, right = (np.repeat(found.column(x).to_numpy().astype(np.int64), n) for x in ("left", "right"))
    return place - left, place + right


def _occurrences(block: pa.Table, found: pa.Table) -> pa.Table:
    begin, end = _ranges(block, found)
    starts, ids = _list(block, "starts").astype(np.int64), block.column("doc_id").combine_chunks().flatten()
    document = np.searchsorted(starts, begin, side="right") - 1
    n = found.column("at").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    group = found.column("group_id").combine_chunks().take(pa.array(np.repeat(np.arange(len(n)), n)))
    return pa.table([group, pa.array(end - begin), ids.take(pa.array(document)), pa.array(begin - starts[document])], _names(GROUPS))


def _kept_by_block(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir in buckets of the column block: what comes back to the blocks
    is shuffled, their texts are not."""
    spark, name = df.sparkSession, f"blocks_{uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, "blocks")
    df.write.bucketBy(buckets, "block").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def _search(documents: DataFrame, length: int, hot: int, size: int, groups: bool) -> tuple[DataFrame, DataFrame]:
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    blocks = _kept_by_block(rows.mapInArrow(_blocks(size, length), BLOCKS))
    counted = blocks.select("block", "gram").mapInArrow(_grams, "home long, gram long, n long")
    counted = counted.withColumn("a", F.sum("n").over(Window.partitionBy("gram"))).filter("a > 1")
    repeated = staged(counted.select("home", "gram", (F.col("a") > hot).alias("hot")), "grams")
    buckets = 1 + repeated.count() // ROWS
    contexts = blocks.groupBy("block").cogroup(repeated.groupBy("home")).applyInArrow(_contexts(buckets, length), CONTEXTS)
    return blocks, contexts.groupBy("bucket").applyInArrow(_found(length, groups), FOUND)


def without_repeats(documents: DataFrame, length: int = LENGTH, hot: int = HOT, size: int = BLOCK) -> DataFrame:
    """Per row of documents: doc_id, n_bytes of its text in UTF-8, n_removed (bytes in strings of length
    bytes that also start elsewhere, in this row or another), n_spans (maximal removed runs), the digest of
    the rest and the spans (start, end). A null text counts as empty; texts shorter than length lose
    nothing; rows of a repeated doc_id are texts of their own; other columns are left out."""
    blocks, found = _search(documents, length, hot, size, False)
    return blocks.groupBy("block").cogroup(found.groupBy("home")).applyInArrow(_removed, RESULT)


def repeat_groups(documents: DataFrame, length: int = LENGTH, hot: int = HOT, size: int = BLOCK) -> DataFrame:
    """(group_id, length, doc_id, start): all occurrences, in bytes, of the maximal repeats among the
    windows of each anchor; for a gram of more than hot occurrences, of its repeated windows."""
    blocks, found = _search(documents, length, hot, size, True)
    return blocks.groupBy("block").cogroup(found.groupBy("home")).applyInArrow(_occurrences, GROUPS)
