"""Operator 2: order-preserving packing of documents into sequences by dynamic programming.

Each input partition is a stream of tokens, documents in their order; nothing is shuffled. A
sequence is a window of the stream of at most LIMIT tokens. Cuts fall at document ends (free), at
sentence ends (SENTENCE; one in every NEAR tokens is enough), or, every GRID tokens of longer sentences, inside (INSIDE). A window of
length n costs its padding, LIMIT - n, or nothing where n is a power of two, and SHORT if it is
below LIMIT; the cheapest cuts come from

    cost[j] = cut[j] + min over i of cost[i] + padding(end[j] - end[i])

The minimum over windows with padding is that of cost[i] - end[i] over a sliding range of i, kept
in a monotone queue; a window of a power of two has one possible i. The stream is worked off in
chunks; the last windows of a chunk are taken up again in the next, so memory is bounded by a chunk
and the longest document."""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from optrace.llm.bpe import byte_table
from optrace.llm.common import Bounded, slices

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIMIT, END = 2048, 1
SENTENCE, INSIDE, SHORT, GRID = 4, 24, 8, 64
#: Tokens gathered before windows are chosen, and how many windows of them are put off.
CHUNK, CARRY = 1 << 19, 4
POWERS = [1 << i for i in range(LIMIT.bit_length())]
SENTENCE_END = re.compile(r"[.!?…。]+")


#: Texts of these characters only are cut into the vocabulary's words here: for them it is plain
#: which are letters, which are white space, and how they are lower-cased.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ſ]*")
PIECES = re.compile("[a-zß-öø-ſ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t\n\r0-9a-zß-öø-ſ]+")


class WordEncoder:
    """Ids of texts under a vocabulary with word ends: each word is encoded once. Words not yet
    known are encoded together, and told apart by the tokens that end a word."""

    def __init__(self, path: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends = np.zeros(len(self.closes), bool)
        for token, i in vocabulary.items():
            self.closes[i] = bool(SENTENCE_END.fullmatch(token.removesuffix("</w>")))
            self.ends[i] = token.endswith("</w>")
        # Pieces need neither normalising nor splitting: only the merges, over bytes spelled as characters.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.spelled = {b: c for c, b in byte_table().items()} | {32: " "}
        self.pieces = Bounded(lambda x: self._encoded(x).tobytes(), 1_500_000)  # ids as bytes

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        text = " ".join(pieces).encode().decode("latin-1").translate(self.spelled)
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(pieces) and cuts[-1] == len(ids):  # else a piece has no token of its own
            flat, cuts = ids.tobytes(), (4 * cuts).tolist()
            self.pieces.update(zip(pieces, [flat[a:b] for a, b in zip([0, *cuts], cuts)]))

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        plain = ["<|" not in x and bool(PLAIN.fullmatch(x)) for x in texts]  # <| may begin a special token
        parts = [PIECES.findall(x.lower()) if easy else None for x, easy in zip(texts, plain)]
        values = [list(map(self.pieces.get, p)) if p else [] for p in parts]
        gaps = [None in v for v in values]
        new = list({y for p, v, gap in zip(parts, values, gaps) if gap for y, z in zip(p, v) if z is None})
        if len(new) + len(self.pieces) > self.pieces.limit:
            self.pieces.clear()
        for at in range(0, len(new), 1000):
            self._learn(new[at : at + 1000])
        known = self.pieces
        for i in (i for i, gap in enumerate(gaps) if gap):
            values[i] = [known[y] if z is None else z for y, z in zip(parts[i], values[i])]
        return [self._encoded(x) if p is None else np.frombuffer(b"".join(v), np.uint32) for x, p, v in zip(texts, parts, values)]

    def ids(self, text: str) -> np.ndarray:
        return self.batch([text])[0]


def cut_points(ids: np.ndarray, closes: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of possible pieces of one document, ascending, and what a cut there costs."""
    length = len(ids)
    ends = np.flatnonzero(closes[ids]) + 1
    if not len(ends) or ends[-1] != length:
        ends = np.append(ends, length)
    if ends[0] <= GRID and (ends[1:] - ends[:-1]).max(initial=0) <= GRID:
        return ends.tolist(), [SENTENCE] * (len(ends) - 1) + [0]
    points = {}
    last = 0
    for end in ends.tolist():
        for inside in range(last + GRID, end, GRID):
            points[inside] = INSIDE
        points[end] = SENTENCE
        last = end
    points[length] = 0
    return list(points), list(points.values())


def _power_starts(position: np.ndarray, powers: list[int]) -> dict[int, list[int]]:
    """For each position the positions that lie a power of two before it, by index."""
    out: dict[int, list[int]] = {}
    for power in powers:
        at = np.minimum(np.searchsorted(position, position - power), len(position) - 1)
        hits = np.flatnonzero(position[at] == position - power)
        for j, i in zip(hits.tolist(), at[hits].tolist()):
            out.setdefault(j, []).append(i)
    return out


def best_cuts(ends: list[int], costs: list[int], limit: int = LIMIT) -> list[int]:
    """Indexes into ends of the cheapest cuts from position 0 to the last end (always a cut).
    Neighbouring ends are at most limit apart."""
    position = [0, *ends]
    starts = _power_starts(np.array(position), [p for p in POWERS if p <= limit])
    total, before = [0.0] * len(position), [0] * len(position)
    queue: deque[int] = deque([0])
    for j in range(1, len(position)):
        end = position[j]
        while position[queue[0]] < end - limit:
            queue.popleft()
        i = queue[0]
        gap = limit - end + position[i]
        best, source = total[i] + gap + (SHORT if gap else 0), i
        for i in starts.get(j, ()):
            cost = total[i] + (SHORT if end - position[i] < limit else 0)
            if cost < best:
                best, source = cost, i
        best += costs[j - 1]
        total[j], before[j] = best, source
        key = best + end
        while queue and total[queue[-1]] + position[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [], len(position) - 1
    while j:
        out.append(j - 1)
        j = before[j]
    return out[::-1]


class _Stream:
    """Documents of one partition waiting for windows."""

    def __init__(self, limit: int):
        self.limit = limit
        self.documents: list[tuple[int | None, np.ndarray]] = []
        self.done = 0  # tokens of the first document that are in earlier sequences
        self.ends: list[int] = []
        self.costs: list[int] = []
        self.length = 0
        self.sequence = TaskContext.get().partitionId() << 32

    def add(self, doc_id: int | None, ids: np.ndarray, closes: np.ndarray) -> None:
        self.documents.append((doc_id, ids))
        ends, costs = cut_points(ids, closes)
        self.ends += [self.length + x for x in ends]
        self.costs += costs
        self.length += len(ids)

    def pieces(self, last: bool) -> Iterator[tuple]:
        """Pieces of the windows chosen; unless last, the final windows stay."""
        if not self.ends:
            return
        cuts = best_cuts(self.ends, self.costs, self.limit)
        if not last:
            cuts = cuts[: max(1, len(cuts) - CARRY)]
        begin, at, offset = 0, 0, self.done
        for cut in cuts:
            end, place = self.ends[cut], 0
            while begin < end:
                doc_id, ids = self.documents[at]
                take = min(end - begin, len(ids) - offset)
                part = np.ascontiguousarray(ids[offset : offset + take], "<u4")
                yield doc_id, offset, take, zlib.crc32(part.tobytes()), len(ids), self.sequence, place
                begin, place, offset = begin + take, place + take, offset + take
                if offset == len(ids):
                    at, offset = at + 1, 0
            self.sequence += 1
        self.documents, self.done = self.documents[at:], offset
        self.ends = [x - begin for x in self.ends[cuts[-1] + 1 :]]
        self.costs = self.costs[cuts[-1] + 1 :]
        self.length -= begin


_encoders: dict[str, WordEncoder] = {}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _packed(path: str, limit: int):
    def rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        some = list(found)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*some)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        stream = _Stream(limit)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                found = coder.batch([x or "" for x in part.column("text").to_pylist()])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), found):
                    stream.add(doc_id, np.append(ids, np.uint32(END)), coder.closes)
                    if stream.length >= CHUNK:
                        yield from rows(stream.pieces(False))
        yield from rows(stream.pieces(True))

    return run


def packed(documents: DataFrame, path: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Pieces of every row of (doc_id, text): doc_id, start (the document's ids before the piece),
    length, ids_crc32, doc_tokens, sequence_id and offset in the sequence. A document is its ids and
    then END; a null text counts as empty, so it is the one id END. Rows that share a doc_id are
    packed one by one. Other columns are left out. limit is a power of two."""
    return documents.select("doc_id", "text").mapInArrow(_packed(path, limit), SCHEMA)
