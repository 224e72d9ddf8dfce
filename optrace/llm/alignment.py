"""Operator 12: alignment of two tokenizers' tokens over the same bytes.

A text is cut where both tokenizers always end a token: before a space or line feed that follows a
character that is no white space, and before a mark such as a full stop that follows a letter or digit.
Byte-level pieces end there, and no piece of the other vocabulary goes across (else texts stay whole). Each segment is encoded by both once per
block of documents. Two dictionaries from cumulative byte end to token index are intersected by
their keys; the sorted common ends slice both id lists into groups, and the overlapping pairs are
expanded slice by slice.

How many documents hold an id pair is counted over blocks: a block gives each of its distinct pairs
once with its number of documents, so that the most frequent pair has a row per block at most. The
totals come back to the blocks by a join, and documents are summed up in their block."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from optrace.llm.bpe import byte_table
from optrace.llm.common import slices, staged
from optrace.session import ROW_BY_ROW

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block of documents.
BLOCK = 6_000_000
SHIFT = 20  # an id pair is left id << SHIFT | right id
CUT, ODD = re.compile(r"(?<=\S)(?=[ \n])"), re.compile(r"\s[ \n]")
LETTER, POINTS = "a-zA-Z0-9À-ÖØ-öø-ÿ", ".,;:!?"
PART = re.compile(f"[ \n][^ \n{POINTS}]*(?:(?<![{LETTER}])[{POINTS}][^ \n{POINTS}]*)*|[{POINTS}][^ \n]*")
ACROSS = re.compile(f"[{LETTER}][{POINTS}]|[^▁]▁|\n")
#: Segments kept from block to block: those of the last two lots of that many.
KEPT = 200_000


class Aligner:
    """Both tokenizers and their tokens' bytes."""

    def __init__(self, left: str, right: str):
        self.left = Tokenizer.from_file(left)
        self.left.encode_special_tokens = True  # their strings in a text are ordinary text
        self.left.no_padding()
        self.left.no_truncation()
        table = byte_table()
        size = self.left.get_vocab_size(with_added_tokens=True)
        self.left_bytes = [bytes(table.get(c, 32) for c in self.left.id_to_token(i) or "") for i in range(size)]
        self.right = sentencepiece.SentencePieceProcessor(model_file=right)
        self.right_bytes = [self._right_bytes(i) for i in range(self.right.get_piece_size())]
        self.space = [self.right.piece_to_id("▁")]
        self.left_lengths, self.right_lengths = (np.array([len(x) for x in t], np.int64) for t in (self.left_bytes, self.right_bytes))
        pieces = [self.right.id_to_piece(i) for i in range(len(self.right_bytes)) if not self.right.is_byte(i)]
        self.cuts = not any(map(ACROSS.search, pieces))  # else texts stay whole
        self.kept: tuple[dict, dict] = {}, {}
        self.numbers = [str(i) for i in range(max(len(self.left_bytes), len(self.right_bytes)))]

    def _right_bytes(self, i: int) -> bytes:
        piece = self.right.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.right.is_byte(i) else piece.replace("▁", " ").encode()

    def segments(self, text: str) -> list[str]:
        """The parts of a space and the text, none of which a token leaves."""
        text = f" {text}"
        return [text] if not self.cuts else CUT.split(text) if ODD.search(text) else PART.findall(text)

    def aligned(self, segments: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of segments: a row of (tokens left, tokens right, groups, links) each, their groups as texts,
        and the codes of all links, in order. A segment that the tokens of either side do not give back
        has zeros."""
        now, old = self.kept
        found = [now.get(x) or old.get(x) for x in segments]
        new = [i for i, x in enumerate(found) if x is None]
        for at in range(0, len(new), 5000):
            some = new[at : at + 5000]
            sums, words, codes = self._aligned([segments[i] for i in some])
            flat, ends = codes.tobytes(), (8 * np.cumsum(sums[:, 3])).tolist()
            for i, row, text, begin, end in zip(some, sums.tolist(), words, [0, *ends], ends):
                found[i] = row, text, flat[begin:end]
        if len(now) > KEPT:
            self.kept = now, _ = {}, now
        now.update((x, y) for x, y in zip(segments, found) if len(x) < 40)
        sums, words, codes = zip(*found) if found else ((), (), ())
        return np.array(sums, np.int64).reshape(-1, 4), words, np.frombuffer(b"".join(codes), np.int64)

    def _aligned(self, segments: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        lefts = [x.ids for x in self.left.encode_batch_fast(segments, add_special_tokens=False)]
        # The library puts a space before each: the one there, or one that no token but its own holds.
        rights = self.right.encode([x[1:] if x[0] == " " else x if x[0] == "\n" else f"\n{x}" for x in segments], num_threads=1)
        rights = [y or self.space if x[0] == " " else y[1 + (x[0] != "\n") :] for x, y in zip(segments, rights)]
        texts = [x.encode() for x in segments]
        good = list(range(len(texts)))
        if not (self._given_back(self.left_bytes, lefts, texts) and self._given_back(self.right_bytes, rights, texts)):
            good = [i for i in good if self._given_back(self.left_bytes, lefts[i : i + 1], texts[i : i + 1])
                    and self._given_back(self.right_bytes, rights[i : i + 1], texts[i : i + 1])]
        sums, words = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        if not good:
            return sums, words, np.zeros(0, np.int64)
        a, b = [y for i in good for y in lefts[i]], [y for i in good for y in rights[i]]
        left, right = np.array(a), np.array(b)
        ends_a, ends_b = np.cumsum(self.left_lengths[left]), np.cumsum(self.right_lengths[right])
        borders = np.cumsum([len(texts[i]) for i in good])  # both sides end a token there

        index_a, index_b = dict(zip(ends_a.tolist(), range(len(a)))), dict(zip(ends_b.tolist(), range(len(b))))
        common = sorted(index_a.keys() & index_b.keys())
        cuts_a, cuts_b = ([0, *(x + 1 for x in map(i.__getitem__, common))] for i in (index_a, index_b))
        texts_a, texts_b = list(map(self.numbers.__getitem__, a)), list(map(self.numbers.__getitem__, b))
        groups = [
            f"{texts_a[i]}|{texts_b[j]}" if m == i + 1 and n == j + 1 else f"{','.join(texts_a[i:m])}|{','.join(texts_b[j:n])}"
            for i, m, j, n in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])
        ]
        # In a slice two tokens overlap in the bytes between two neighbouring ends of either side.
        ends = np.union1d(ends_a, ends_b)
        codes = left[np.searchsorted(ends_a, ends)].astype(np.int64) << SHIFT | right[np.searchsorted(ends_b, ends)]
        last = np.searchsorted(np.array(common), borders) + 1
        first = np.concatenate([[0], last[:-1]])
        for i, one, two in zip(good, first.tolist(), last.tolist()):
            words[i] = ";".join(groups[one:two])
        places = [np.searchsorted(x, borders) + 1 for x in (ends_a, ends_b, np.array(common), ends)]
        sums[good] = np.stack([np.diff(x, prepend=0) for x in places], axis=1)
        return sums, words, codes

    @staticmethod
    def _given_back(tokens: list[bytes], ids: list[list[int]], texts: list[bytes]) -> bool:
        return all(b"".join([tokens[i] for i in x]) == text for x, text in zip(ids, texts))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(left: str, right: str) -> Aligner:
    if (left, right) not in _aligners:
        _aligners[left, right] = Aligner(left, right)
    return _aligners[left, right]


BLOCKS = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, pairs array<long>, n_docs array<int>, starts array<int>, place array<int>, times array<int>"
)


def _blocks(left: str, right: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = aligner(left, right), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", size):
                row = _block(both, part.column("text").to_pylist()) | {"block": number, "doc_id": part.column("doc_id")}
                number += 1
                yield pa.RecordBatch.from_arrays([_cell(row[x.split()[0]], x.split()[1]) for x in BLOCKS.split(", ")],
                                                 [x.split()[0] for x in BLOCKS.split(", ")])

    return run


KINDS = {"array<long>": pa.int64(), "array<int>": pa.int32(), "array<string>": pa.string()}


def _cell(values, kind: str) -> pa.Array:
    if kind == "long":
        return pa.array([values], pa.int64())
    values = values if isinstance(values, pa.Array) else pa.array(values, KINDS[kind])
    return pa.ListArray.from_arrays([0, len(values)], values.cast(KINDS[kind]))


def _block(both: Aligner, texts: list[str | None]) -> dict:
    """Figures of each document, the block's distinct pairs, and of each document which of them it
    holds (place, from starts) and how often (times)."""
    index: dict[str, int] = defaultdict(count().__next__)
    docs = [np.array([index[x] for x in both.segments(t)] if t else [], np.int64) for t in texts]
    sums, words, codes = both.aligned(list(index))
    bad = sums[:, 0] == 0
    docs = [x[:0] if bad[x].any() else x for x in docs]
    totals = np.array([sums[x].sum(axis=0) for x in docs], np.int64).reshape(-1, 4)
    digests = [hashlib.sha256(";".join([words[i] for i in x.tolist()]).encode()).hexdigest() if len(x) else "" for x in docs]

    pairs, where = np.unique(codes, return_inverse=True)
    lengths = sums[:, 3]
    begins, width = np.cumsum(lengths) - lengths, max(1, len(pairs))
    keys, times = [], []
    for i, x in enumerate(docs):
        n = lengths[x]
        at = np.repeat(begins[x] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        key, often = np.unique(where[at], return_counts=True)
        keys.append(key + i * width)
        times.append(often)
    key = np.concatenate([np.zeros(0, np.int64), *keys])
    place = key % width
    return {
        **{name: totals[:, k] for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        "groups_sha256": digests, "pairs": pairs, "n_docs": np.bincount(place, minlength=len(pairs)).astype(np.int32),
        "starts": np.cumsum([0, *(len(x) for x in keys)]).astype(np.int32), "place": place.astype(np.int32),
        "times": np.concatenate([np.zeros(0, np.int64), *times]).astype(np.int32),
    }


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _list(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks().flatten()


def _summed(block: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block, from its row and its pairs' totals."""
    n = np.zeros(block.column("n_pairs")[0].as_py() + 1, np.int64)
    best = np.zeros(len(n), np.int64)
    at = counts.column("pos").to_numpy()
    n[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
    place, times, starts = (_list(block, x).to_numpy() for x in ("place", "times", "starts"))

    def per_document(values: np.ndarray) -> pa.Array:
        sums = np.concatenate([[0], np.cumsum(times * values[place])])
        return pa.array(np.diff(sums[starts]), pa.int64())

    names = [x.split()[0] for x in RESULT.split(", ")]
    own = {"n_best": per_document(best), "count_sum": per_document(n)}
    return pa.table([own[x] if x in own else _list(block, x) for x in names], names)


def alignments(documents: DataFrame, left: str | None = None, right: str | None = None, size: int = BLOCK) -> DataFrame:
    """Per row of documents: doc_id, n_a and n_b (tokens), n_groups, n_links (overlapping token
    pairs), n_best (links whose id pair is held linked by as many documents as the best pair of its
    left id), count_sum (those numbers over all links) and groups_sha256. A text that is null, empty
    or not given back by either tokenizer has no tokens: zeros and an empty string. Rows of a
    repeated doc_id are documents of their own; other columns are left out."""
    left, right = left or public_tokenizers.path(LEFT), right or public_tokenizers.path(RIGHT)
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    blocks = staged(rows.mapInArrow(_blocks(left, right, size), BLOCKS), "alignment", ROW_BY_ROW)
    held = blocks.select(F.col("block").alias("home"), F.posexplode(F.arrays_zip("pairs", "n_docs"))).select(
        "home", "pos", F.col("col.pairs").alias("pair"), F.col("col.n_docs").alias("n_docs")
    )
    counts = staged(held.groupBy("pair").agg(F.sum("n_docs").alias("n")).withColumn("left", F.shiftright("pair", SHIFT)), "pairs")
    highest = counts.groupBy("left").agg(F.max("n").alias("highest"))  # a row for each id of the vocabulary at most
    counts = counts.join(F.broadcast(highest), "left").select("pair", "n", (F.col("n") == F.col("highest")).cast("int").alias("best"))
    back = held.select("home", "pos", "pair").join(counts, "pair").select("home", "pos", "n", "best")
    own = blocks.withColumn("n_pairs", F.size("pairs")).drop("pairs", "n_docs")  # the pairs stay where they are
    return own.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(_summed, RESULT)
