"""BPE and packing: exact round trips and a plain dynamic programme."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from optrace.llm import bpe, packing


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(bpe.VOCABULARY)
    found.no_padding()
    found.no_truncation()
    return found


def long_texts():
    pick = random.Random(3)
    letters = lambda n, of: "".join(pick.choice(of) for _ in range(n))
    return [
        "a" * 5000, letters(9000, "abcdefgh"), " " + letters(3001, "etaoinshr"), "x " + "qu" * 2000 + "'s é" + "z" * 3000 + "é", "9" * 3000,
        "!?" * 900 + letters(2000, "th") + "#" * 700, "don't " * 5, "'ll" + "e" * 1200 + "'re", "The <|endoftext|> end <|", "  a  b\n\n c \t\n", "", "   ",
        " x y\x0bz\x1c!", "日本語" * 400, letters(1500, "日本語漢字仮名") + "。" + letters(900, "абвгдежз"), "ไทยภาษา" * 300, letters(1200, "🙂🙃é"), " " * 1500 + "語", "x" * 700 + "語" + "。" * 800, "é" * 2000, letters(600, "ab") + "\n" + letters(700, "ab"), "\x00\x01\x7f", "🙂🙂" * 50,
    ]


@pytest.mark.parametrize("leaf", [16, 512])
def test_encoding_is_the_library_s(library, leaf):
    coder = bpe.Encoder(leaf=leaf)
    for text in long_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.ids(text).tolist() == ids
        assert coder.decoded(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)


def test_decoding_of_cut_characters(library):
    ids = library.encode("日本語🙂", add_special_tokens=False).ids
    for cut in range(len(ids)):
        assert bpe.Encoder().decoded(np.array(ids[:cut], np.uint32)) == library.decode(ids[:cut], skip_special_tokens=False)


def test_encoded_rows(documents, library, empty):
    rows = bpe.encoded(documents).collect()
    assert len(rows) == documents.count()
    for x in rows:
        assert x.ids == library.encode(x.text or "", add_special_tokens=False).ids and x.decoded == (x.text or "")
    assert bpe.encoded(empty).count() == 0
    digests = {(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.encoding_digests(documents).collect()}
    assert digests == {
        (x.doc_id, len(x.ids), hashlib.sha256(np.array(x.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(x.decoded.encode()).hexdigest()) for x in rows
    }


def test_word_ids_are_the_library_s():
    library, coder = Tokenizer.from_file(packing.VOCABULARY), packing.WordEncoder()
    for text in long_texts():
        assert coder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def plain_cost(ends, costs, limit):
    """Cheapest cost over all choices of cuts, from every pair of positions."""
    position = [0, *ends]
    best = [0.0] + [float("inf")] * len(ends)
    for j in range(1, len(position)):
        for i in range(j):
            n = position[j] - position[i]
            if n <= limit:
                pad = 0 if n & (n - 1) == 0 else limit - n
                best[j] = min(best[j], best[i] + pad + (packing.SHORT if n < limit else 0) + costs[j - 1])
    return best[-1]


def test_cheapest_cuts():
    pick = random.Random(4)
    for _ in range(200):
        limit = pick.choice([16, 32, 64])
        ends = np.cumsum([pick.randrange(1, limit // 2) for _ in range(pick.randrange(1, 40))]).tolist()
        costs = [pick.choice([0, 4, 24]) for _ in ends]
        cuts = packing.best_cuts(ends, costs, limit)
        position = [0] + [ends[i] for i in cuts]
        lengths = np.diff(position).tolist()
        assert position[-1] == ends[-1] and max(lengths) <= limit
        cost = sum((0 if n & (n - 1) == 0 else limit - n) + (packing.SHORT if n < limit else 0) for n in lengths) + sum(costs[i] for i in cuts)
        assert cost == plain_cost(ends, costs, limit)


def test_pieces_hold_every_id_once(documents, empty):
    library = Tokenizer.from_file(packing.VOCABULARY)
    rows = packing.packed(documents).collect()
    wanted = sorted(((x.doc_id, [*library.encode(x.text or "", add_special_tokens=False).ids, packing.END]) for x in documents.collect()), key=str)
    assert sum(x.length for x in rows) == sum(len(ids) for _, ids in wanted)
    ids_of = defaultdict(list)
    for doc_id, ids in wanted:
        ids_of[doc_id].append(ids)
    for x in rows:
        assert any(len(ids) == x.doc_tokens and zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32 for ids in ids_of[x.doc_id])
    sequences = defaultdict(list)
    for x in rows:
        sequences[x.sequence_id].append((x.offset, x.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LIMIT
    assert packing.packed(empty).count() == 0


def test_little_padding(spark):
    rows = packing.packed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("sequence_id").sum("length").collect()
    lengths = [x[1] for x in rows]
    padding = sum(0 if n & (n - 1) == 0 else packing.LIMIT - n for n in lengths)
    assert padding < 0.01 * sum(lengths)
