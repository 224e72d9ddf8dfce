"""Operator 7: exact BPE encoding and decoding, long unsplit text by tree concatenation.

Text is cut into the pieces of the vocabulary's pre-tokenisation, and equal pieces are encoded once
per worker. A long piece that stays unsplit is halved down to short leaves, all leaves are encoded
in one batch, and neighbours are joined up the tree: the tokens around the join are encoded anew
as one text, in a window that grows until its first and last token are those the two sides already
had. BPE is local (a token sequence is the encoding of its text if every two neighbours are), so
the joined sequence is then the encoding of the whole."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from optrace.llm.common import Bounded, slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LEAF, WINDOW = 512, 8
#: Texts of these characters only are cut into the vocabulary's pieces here: for them it is plain
#: which are letters, digits and white space. Others are cut by the library.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ſ]*")
LETTER = "a-zA-ZÀ-ÖØ-öø-ſ"
PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^ \t\n\r0-9{LETTER}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"
)


@lru_cache
def long_run(length: int) -> re.Pattern:
    """A run that may be one piece of more than that many characters."""
    return re.compile(rf"\S{{{length + 1}}}|\s{{{length + 1}}}")


class Encoder:
    """Encoding and decoding with a byte-level vocabulary file."""

    def __init__(self, path: str = VOCABULARY, leaf: int = LEAF):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer, self.leaf = Tokenizer.from_file(path), leaf
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        table = byte_table()
        added = self.tokenizer.get_added_tokens_decoder()
        tokens = [
            added[i].content.encode() if i in added else bytes(table[c] for c in self.tokenizer.id_to_token(i) or "")
            for i in range(size)
        ]
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.array([x.startswith(b" ") for x in tokens])
        self.pieces = Bounded(lambda x: np.array(self._piece(x), np.uint32).tobytes(), 500_000)  # ids as bytes

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text as the library gives them."""
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text. Pieces not yet known that begin with a space are encoded together and
        told apart by it."""
        plain = [bool(PLAIN.fullmatch(x)) and "<|" not in x for x in texts]  # <| may begin a special token
        parts = [PIECES.findall(x) if easy else None for x, easy in zip(texts, plain)]
        values = [list(map(self.pieces.get, p)) if p else [] for p in parts]
        gaps = [None in v for v in values]
        new = {y for p, v, gap in zip(parts, values, gaps) if gap for y, z in zip(p, v) if z is None}
        if len(new) + len(self.pieces) > self.pieces.limit:
            self.pieces.clear()
        spaced = [x for x in new if x[0] == " " and len(x) <= self.leaf and x[-1] != " " and x[1] not in "\t\n\r "]
        for at in range(0, len(spaced), 1000):
            self._learn(spaced[at : at + 1000])
        known = self.pieces
        for i in (i for i, gap in enumerate(gaps) if gap):
            values[i] = [known[y] if z is None else z for y, z in zip(parts[i], values[i])]
        return [
            np.array(self._cut(x), np.uint32) if p is None else np.frombuffer(b"".join(v), np.uint32) for x, p, v in zip(texts, parts, values)
        ]

    def _learn(self, pieces: list[str]) -> None:
        ids = np.array(self._plain("".join(pieces)), np.uint32)
        cuts = np.flatnonzero(self.spaced[ids])
        if len(cuts) == len(pieces) and cuts[0] == 0:
            flat, cuts = ids.tobytes(), (4 * cuts).tolist()
            self.pieces.update(zip(pieces, [flat[a:b] for a, b in zip(cuts, [*cuts[1:], len(flat)])]))

    def decoded(self, ids: np.ndarray) -> str:
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        places = np.repeat(self.starts[ids] - before, lengths) + np.arange(int(lengths.sum()))
        return self.bytes[places].tobytes().decode("utf-8", "replace")

    def _text(self, ids: list[int]) -> str | None:
        """The ids' bytes as text, None where they are not whole characters."""
        found = b"".join(self.bytes[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes() for i in ids)
        try:
            return found.decode()
        except UnicodeDecodeError:
            return None

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _cut(self, text: str) -> list[int]:
        """Ids of a text of any characters: where it may hold a long piece it is cut by the vocabulary's own
        pre-tokenisation, else the library has it whole."""
        if "<|" in text or not long_run(self.leaf).search(text):
            return self._plain(text)
        return [i for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text) for i in self._piece(text[a:b])]

    def _piece(self, piece: str) -> list[int]:
        return self._plain(piece) if len(piece) <= self.leaf else self.tree(piece)

    def tree(self, text: str) -> list[int]:
        """Ids of one long piece."""
        if len(text) <= self.leaf:
            return self._plain(text)
        count = 1 << (-(-len(text) // self.leaf) - 1).bit_length()
        cuts = [len(text) * i // count for i in range(count + 1)]
        parts = [x.ids for x in self.tokenizer.encode_batch([text[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)]
        while len(parts) > 1:
            parts = [self._joined(parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]
        return parts[0]

    def _joined(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        size = WINDOW
        while True:
            a, b = min(size, len(left)), min(size, len(right))
            text = self._text([*left[-a:], *right[:b]])
            if text is None:  # the window begins or ends inside a character
                size += 1
                continue
            new = self._plain(text)
            if (a == len(left) or new[0] == left[-a]) and (b == len(right) or new[-1] == right[b - 1]):
                return [*left[: len(left) - a], *new, *right[b:]]
            size *= 2


def byte_table() -> dict[str, int]:
    """Byte of each character that stands for a byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, other bytes for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _round_trips(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                rows = []
                for ids in coder.batch([x or "" for x in part.column("text").to_pylist()]):
                    rows.append((ids, coder.decoded(ids)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([x.tolist() for x, _ in rows], pa.list_(pa.int32())), pa.array([x for _, x in rows], pa.string())],
                    [*part.schema.names, "ids", "decoded"],
                )

    return run


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                n, one, two = [], [], []
                for ids in coder.batch([x or "" for x in part.column("text").to_pylist()]):
                    n.append(len(ids))
                    one.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    two.append(hashlib.sha256(coder.decoded(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(one), pa.array(two)],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoded(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Every row of documents with ids (array of int) and decoded (string). A null text counts as
    empty. Columns of these names are replaced."""
    documents = documents.drop("ids", "decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(_round_trips(path), f"{schema}, ids array<int>, decoded string")


def encoding_digests(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, without moving the ids out of
    the worker: ids as little-endian unsigned 32-bit integers, the decoded text in UTF-8."""
    return documents.select("doc_id", "text").mapInArrow(
        _digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
