"""Alignment of two tokenizers against whole texts encoded by the libraries and plain spans."""

import collections
import hashlib

import public_tokenizers as vocabularies
import pyarrow.parquet as pq
import sentencepiece
from tokenizers import Tokenizer

from optrace.llm import alignment
from optrace.llm.bpe import byte_table

ODD = [
    None, "", " ", "  a  b ", "\n x\n  y ", "x▁y z", "日本語 テキスト mixed 🙂🙂", "<|endoftext|> <s> <0x0A> a", "'s don't  't \t tab", "a" * 5000,
    "\x1c \x85 b\xa0 c 　 d", "é" * 300 + " x", "  ", "a\r\n b", "x  y", " lead", "trail ", "\x00 \x7f",
]


def plain(texts):
    left = Tokenizer.from_file(vocabularies.path(alignment.LEFT))
    left.encode_special_tokens = True
    right, table = sentencepiece.SentencePieceProcessor(model_file=vocabularies.path(alignment.RIGHT)), byte_table()
    out, counts = [], collections.Counter()
    for text in texts:
        a, b = (left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)) if text else ([], [])
        one = [bytes(table[c] for c in left.id_to_token(i)) for i in a]
        two = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(one) != (" " + text).encode() or b"".join(two) != (" " + text).encode():
            out.append(None)
            continue
        bounds = []
        for tokens in (one, two):
            ends = [sum(map(len, tokens[:0]))]
            for x in tokens:
                ends.append(ends[-1] + len(x))
            bounds.append(list(zip(ends, ends[1:])))
        links, first = [], 0
        for i, (start, end) in enumerate(bounds[0]):
            while bounds[1][first][1] <= start:
                first += 1
            j = first
            while j < len(b) and bounds[1][j][0] < end:
                links.append((a[i], b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in bounds[0]} & {e for _, e in bounds[1]}):
            n, m = i, j
            while i < len(a) and bounds[0][i][1] <= end:
                i += 1
            while j < len(b) and bounds[1][j][1] <= end:
                j += 1
            groups.append(",".join(map(str, a[n:i])) + "|" + ",".join(map(str, b[m:j])))
        out.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        counts.update(set(links))
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if x is None else
        (*x[:3], len(x[3]), sum(counts[y] == best[y[0]] for y in x[3]), sum(counts[y] for y in x[3]), x[4]) for x in out
    ]


def rows_of(found):
    return sorted(((x.doc_id, x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) for x in found.collect()), key=str)


def test_alignments_are_those_of_whole_texts(spark, documents):
    odd = spark.createDataFrame([(9000 + i, t, "y") for i, t in enumerate(ODD)], "doc_id long, text string, pairs string")
    both = documents.select("doc_id", "text").union(odd.select("doc_id", "text")).repartition(3)
    rows = [(x.doc_id, x.text) for x in both.collect()]
    wanted = sorted([(i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows]))], key=str)
    assert rows_of(alignment.alignments(both, size=4000)) == wanted
    assert rows_of(alignment.alignments(both.withColumn("pairs", both.text).withColumn("block", both.text))) == wanted


def test_table(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [(x.doc_id, x.text) for x in table.collect()]
    assert rows_of(alignment.alignments(table)) == sorted([(i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows]))], key=str)


def test_empty(empty):
    assert alignment.alignments(empty).count() == 0


def test_blocks_are_read_one_by_one(spark, monkeypatch):
    """Neither a writer nor a reader holds more than a block: each has a row group of its own."""
    kept, written = alignment.staged, {}

    def staged(df, name, *more):
        written[name] = kept(df, name, *more)
        return written[name]

    monkeypatch.setattr(alignment, "staged", staged)
    rows = spark.createDataFrame([(i, f"some text {i} of it") for i in range(90)], "doc_id long, text string").coalesce(1)
    assert alignment.alignments(rows, size=40).count() == 90
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in written["alignment"].inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert len(groups) > 20 and set(groups) == {1}
