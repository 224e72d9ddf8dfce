"""Collocations against SQL over the phrases' texts, and against plain counts."""

import random
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

from optrace.llm import phrases
from optrace.llm.queries import collocations_sql

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(8)
    words = ["an", "Be", "ce", "de\x01", "é", "日本", "f-g", "h"]
    rows = []
    for i in range(300):
        parts = [pick.choice(words[: pick.choice([2, 4, 8])]) for _ in range(pick.randrange(0, 60))]
        rows.append((i, "".join(x + pick.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n", "\x0b"]) for x in parts), pick.choice(["en", "de", None, "und"])))
    return rows + [(i, "same old line here. Same  old line", "fr") for i in range(12)] + [(900, None, "en"), (901, "", None), (902, " \n\t.;", "en"), (None, "an Be an", "en"), rows[5]]


def sql_rows(rows, **limits):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    cursor = con.execute(collocations_sql("documents", **limits))
    names = [x[0] for x in cursor.description]
    return sorted(tuple(r[names.index(c)] for c in COLUMNS) for r in cursor.fetchall())


@pytest.mark.parametrize("limits", [{}, {"longest": 2, "least": 3}, {"longest": 4, "least": 2}, {"top": 5, "least": 1, "inside": 90}])
def test_rows_are_those_of_sql(spark, texts, limits):
    table = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(4)
    found = phrases.collocations(table.selectExpr("*", "lang AS word", "doc_id AS gid"), size=2000, **limits)
    assert found.columns == COLUMNS
    assert sorted(tuple(x) for x in found.collect()) == sql_rows(texts, **limits)


def test_counts_of_phrases(spark):
    rows = [(1, "a a a a. a a", "x"), (2, "A b a b", "x")]
    words, counts, totals = phrases.frequent_phrases(spark.createDataFrame(rows, "doc_id long, text string, lang string"), longest=3, least=1)
    name = {x.gid: x.word for x in words.collect()}
    plain = Counter()
    for _, text, _ in rows:
        for piece in text.lower().split("."):
            w = piece.split()
            plain.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert {tuple(name[i] for i in x.ids): x.a for x in counts.collect()} == plain
    assert [tuple(x) for x in totals.collect()] == [("x", 10)]


def test_products_beyond_64_bits(spark):
    found = phrases.collocations(spark.createDataFrame([(i, "one two " * 4000, "x") for i in range(800)], "doc_id long, text string, lang string"), longest=2)
    first = found.orderBy("rank").first()
    assert (first.phrase, first.a, first.l, first.score) == ("one two", 3_200_000, 3_200_000, 1_000_000)


def test_empty(empty):
    assert phrases.collocations(empty).count() == 0


def test_blocks_are_read_one_by_one(spark, monkeypatch):
    """Neither a writer nor a reader holds more than a block: each has a row group of its own."""
    kept, written = phrases.staged, []

    def staged(df, name, *more):
        written.append((name, kept(df, name, *more)))
        return written[-1][1]

    monkeypatch.setattr(phrases, "staged", staged)
    rows = [(lang, f"a b c {i % 7} a b") for i in range(60) for lang in ("en", "fr")]
    phrases.frequent_phrases(spark.createDataFrame(rows, "lang string, text string").coalesce(1), longest=4, least=2, size=100)
    assert [name for name, _ in written].count("relation") == 2
    for _, df in (x for x in written if x[0] in ("occurrences", "relation")):
        files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in df.inputFiles()]
        groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
        assert len(groups) > 20 and set(groups) == {1}
