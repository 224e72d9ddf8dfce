"""Operator 11: phrase collocations by relational mining in the manner of SETM.

R_k is the relation of the occurrences (piece, position, phrase of k words), kept sorted by piece and
position and persisted in blocks of documents, since no piece leaves its document. R_(k+1) is the merge
join of R_k with the words of R_1 in the same piece at the next position; in a block both lie in one
order, so the join is one step along it. Groups are then counted over all blocks, and only occurrences
of frequent groups (semi-join) are extended to the next length.

A block gives each of its distinct phrases once, with its number of occurrences, so the most frequent
phrase has a row per block at most: no word or phrase is a hot key. Phrases of more than one word travel
as two numbers, that of the frequent phrase without its last word and that of the last word."""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from optrace.llm.common import slices, staged
from optrace.session import ROW_BY_ROW, ZSTD

LONGEST, LEAST, TOP, INSIDE = 3, 10, 2000, 50
#: Bytes of text in a block.
BLOCK = 8_000_000
ENDS = ".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans((string.ascii_uppercase + "\t" + ENDS).encode(), (string.ascii_lowercase + " " + "\n" * len(ENDS)).encode())
BREAK = -1

BLOCKS = "block long, lang string, words array<string>, times array<long>, tokens array<int>"
RELATION = "block long, tokens array<int>, ids array<long>, phrases array<int>, phrase_ids array<long>"
ROWS = "home long, i int, g long, w long, n long"


def _row(schema: str, *values) -> pa.RecordBatch:
    kinds = {"array<string>": pa.string(), "array<long>": pa.int64(), "array<int>": pa.int32()}
    names, arrays = [x.split()[0] for x in schema.split(", ")], []
    for x, value in zip(schema.split(", "), values):
        kind = x.split()[1]
        if kind in kinds:
            value = pa.array(value, kinds[kind])
            arrays.append(pa.ListArray.from_arrays([0, len(value)], value))
        else:
            arrays.append(pa.array([value], pa.string() if kind == "string" else pa.int64()))
    return pa.RecordBatch.from_arrays(arrays, names)


def _blocks(size: int):
    """R_1: of each language in a block its distinct words, how often each occurs, and the words'
    places in order of piece and position, with a break between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", size):
                by = defaultdict(list)
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    if text:
                        by[lang].append(text)
                for lang, texts in by.items():
                    index: dict[bytes, int] = defaultdict(count().__next__)
                    index[b"\n"]
                    parts = "\n".join(texts).encode().translate(TABLE).replace(b"\n", b" \n ").split(b" ")
                    tokens = np.fromiter((index[x] for x in parts if x), np.int32)
                    times = np.bincount(tokens, minlength=len(index))[1:]
                    yield _row(BLOCKS, number, lang, [x.decode() for x in index][1:], times, tokens - 1)
                    number += 1

    return run


def _column(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    found = table.column(name)
    return (found.combine_chunks() if isinstance(table, pa.Table) else found).flatten().to_numpy(zero_copy_only=False)


def _first_relation(block: pa.Table, frequent: pa.Table) -> pa.Table:
    """R_1 of a block with its frequent words only."""
    tokens = _column(block, "tokens").copy()
    ids = np.full(block.column("n_words")[0].as_py() + 1, BREAK, np.int64)  # the last stands for a break
    ids[frequent.column("i").to_numpy()] = frequent.column("gid").to_numpy()
    tokens[ids[tokens] < 0] = BREAK
    return pa.Table.from_batches([_row(RELATION, block.column("block")[0].as_py(), tokens, ids[:-1], [], [])])


class Relation:
    """R_k of a block, and how it is extended by a word."""

    def __init__(self, table: pa.Table | pa.RecordBatch, length: int):
        self.block, self.length = table.column("block")[0].as_py(), length
        self.tokens, self.ids, self.phrases, self.phrase_ids = (_column(table, x) for x in ("tokens", "ids", "phrases", "phrase_ids"))
        if length == 1:
            self.phrases, self.phrase_ids = self.tokens, self.ids

    def extended(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a frequent phrase and the one a word further on start, and the codes
        of the phrases longer by a word there."""
        at = np.flatnonzero((self.phrases[:-1] >= 0) & (self.phrases[1:] >= 0))
        return at, self.phrases[at].astype(np.int64) * max(1, len(self.ids)) + self.tokens[at + self.length]

    def groups(self) -> pa.Table:
        """The block's distinct phrases longer by a word and their numbers of occurrences."""
        codes, n = np.unique(self.extended()[1], return_counts=True)
        width = max(1, len(self.ids))
        columns = [np.full(len(codes), self.block), np.arange(len(codes), dtype=np.int32), self.phrase_ids[codes // width], self.ids[codes % width], n]
        return pa.table(columns, [x.split()[0] for x in ROWS.split(", ")])

    def kept(self, frequent: pa.Table) -> Relation:
        """R_(k+1): the extended occurrences whose phrase is frequent."""
        at, codes = self.extended()
        codes, place = np.unique(codes, return_inverse=True)
        ids = np.full(len(codes), BREAK, np.int64)
        ids[frequent.column("i").to_numpy()] = frequent.column("gid").to_numpy()
        self.phrases = np.full(len(self.tokens), BREAK, np.int32)
        self.phrases[at] = np.where(ids[place] >= 0, place, BREAK)
        self.phrase_ids, self.length = ids, self.length + 1
        return self

    def table(self) -> pa.Table:
        return pa.Table.from_batches([_row(RELATION, self.block, self.tokens, self.ids, self.phrases, self.phrase_ids)])


def _groups(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from Relation(batch.slice(i, 1), length).groups().to_batches(max_chunksize=100_000)

    return run


def _frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows (home, i, keys) of the groups that occur least times, with the group's number (gid) and
    occurrences (a); first marks one row of each group."""
    own = Window.partitionBy(*keys)
    rows = rows.withColumn("a", F.sum("n").over(own)).filter(F.col("a") >= least).withColumn("number", F.monotonically_increasing_id())
    rows = rows.withColumn("gid", F.min("number").over(own))
    return staged(rows.select("home", "i", *keys, "a", "gid", (F.col("gid") == F.col("number")).alias("first")), "frequent", ZSTD)


def _joined(blocks: DataFrame, frequent: DataFrame, function, schema: str) -> DataFrame:
    return blocks.groupBy("block").cogroup(frequent.select("home", "i", "gid").groupBy("home")).applyInArrow(function, schema)


def frequent_phrases(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, size: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): words has (lang, word, gid, a) of the words that occur least times;
    phrases has (lang, ids, a) of all such phrases of up to longest words, ids being gids of words;
    totals has (lang, n), all word occurrences of each language. lang null is `und`; a null text
    counts as empty; other columns of documents are left out."""
    rows = documents.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    blocks = staged(rows.mapInArrow(_blocks(size), BLOCKS), "occurrences", ROW_BY_ROW)
    totals = blocks.select("lang", F.aggregate("times", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    held = blocks.select(F.col("block").alias("home"), "lang", F.posexplode(F.arrays_zip("words", "times")))
    held = held.select("home", "lang", F.col("pos").alias("i"), F.col("col.words").alias("word"), F.col("col.times").alias("n"))
    found = _frequent(held, ["lang", "word"], least)
    words = found.filter("first").select("lang", "word", "gid", "a")
    counts = words.select("lang", F.array("gid").alias("ids"), "a")
    levels = counts.withColumn("gid", F.col("ids")[0])
    places = blocks.select("block", "tokens", F.size("times").alias("n_words"))  # the words stay where they are
    relation = staged(_joined(places, found, _first_relation, RELATION), "relation", ROW_BY_ROW) if longest > 1 else None
    for length in range(1, longest):  # R_length is known, phrases longer by a word are looked for
        if length == 1:
            groups = relation.mapInArrow(_groups(1), ROWS)
        elif length == longest - 1:  # nothing follows that would need the relation
            groups = _joined(relation, found, _extension(length), ROWS)
        else:
            relation = staged(_joined(relation, found, _next_relation(length), RELATION), "relation", ROW_BY_ROW)
            groups = relation.mapInArrow(_groups(length), ROWS)
        if length < longest - 1:
            found = _frequent(groups, ["g", "w"], least)
            new = found.filter("first").select("g", "w", "a", "gid")
        else:
            new = staged(groups.groupBy("g", "w").agg(F.sum("n").alias("a")).filter(F.col("a") >= least), "frequent").withColumn("gid", F.lit(None).cast("long"))
        shorter = levels.select("lang", F.col("ids").alias("begin"), F.col("gid").alias("g"))
        levels = new.join(shorter, "g").select("lang", F.concat("begin", F.array("w")).alias("ids"), "a", "gid")
        counts = counts.union(levels.select("lang", "ids", "a"))
    return words, staged(counts, "phrases"), totals


def _extension(length: int):
    def run(block: pa.Table, frequent: pa.Table) -> pa.Table:
        return Relation(block, length - 1).kept(frequent).groups()

    return run


def _next_relation(length: int):
    def run(block: pa.Table, frequent: pa.Table) -> pa.Table:
        return Relation(block, length - 1).kept(frequent).table()

    return run


def collocations(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = INSIDE, size: int = BLOCK) -> DataFrame:
    """The top phrases of each language: (lang, rank, phrase, a, l, r, n, score). A phrase of 2 to longest
    words that occurs a >= least times is scored by its weakest cut, floor(10^6 * a * a / (l * r)), l
    and r being the occurrences of the two parts. One that lies inside a longer such phrase with at
    least inside percent of its occurrences is left out. Ties go to the larger a, then to the smaller
    phrase; a language with fewer phrases gives all, an empty table gives none."""
    words, counts, totals = frequent_phrases(documents, longest, least, size)
    candidates = counts.filter(F.size("ids") >= 2)
    within = candidates.filter(F.size("ids") >= 3).select(
        F.col("a").alias("longer"),
        F.explode(F.expr("""flatten(transform(sequence(2, size(ids) - 1), n ->
            transform(sequence(1, size(ids) - n + 1), s -> slice(ids, s, n))))""")).alias("ids"),
    ).groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = candidates.join(within, "ids", "left").filter(F.expr(f"longer IS NULL OR 100 * longer < {int(inside)} * a")).drop("longer")

    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(ids, 1, k)").alias("one"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("two"))
    cuts = cuts.join(counts.select(F.col("ids").alias("one"), F.col("a").alias("l")), "one")
    cuts = cuts.join(counts.select(F.col("ids").alias("two"), F.col("a").alias("r")), "two")
    # 15 + 15 + 7 digits and 18 + 18 digits: both products are exact in 38.
    score = F.expr("""CAST((CAST(a AS decimal(15,0)) * CAST(a AS decimal(15,0)) * CAST(1000000 AS decimal(7,0)))
        div (CAST(l AS decimal(18,0)) * CAST(r AS decimal(18,0))) AS long)""")
    scored = cuts.withColumn("score", score).groupBy("lang", "ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = scored.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place")  # with all that tie for the last place
    named = near.select("*", F.posexplode("ids").alias("pos", "gid")).join(words.select("gid", "word"), "gid")
    named = named.groupBy("lang", "ids", "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("parts"))
    named = named.withColumn("phrase", F.expr("array_join(transform(parts, x -> x.word), ' ')"))
    ranked = named.withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
