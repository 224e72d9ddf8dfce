"""Column functions against plain Python rules, odd Unicode included."""

import json

import pytest
from pyspark.sql import functions as F

from optrace.functions import cleaning, names, paths, prompts, text

ODD = ["", " ", "a b", "\x1ca\x85", " x y　", "l1\r\nl2\x0bl3 l4\n", "\tTab\n\n", "é̈ß", "a\x1eb\x1fc\n", "  <think>x\ny"]


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_whitespace_matches_python(spark):
    got = column(spark, ODD, text.strip(F.col("v")), text.fold_blanks(F.col("v")), text.lines(F.col("v")))
    for value, (stripped, folded, parts) in zip(ODD, got):
        assert stripped == value.strip()
        assert folded == " ".join(value.split())
        assert parts == (value.splitlines() or [""])


def test_every_low_code_point_is_blank_as_in_python(spark):
    codes = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    got = column(spark, [chr(c) for c in codes], text.strip(F.col("v")) == "")
    assert [c for c, (blank,) in zip(codes, got) if blank != chr(c).isspace()] == []


def test_sanitize(spark):
    value = "a\x00b\x07\tc\r\n\x1f "
    assert column(spark, [value, None], text.sanitize_text(F.col("v")), text.sanitize_tree(F.col("v"))) == [
        ("ab\tc\r\n ", "ab\tc"), ("", ""),
    ]


@pytest.mark.parametrize("size, shown", [
    (None, ""), (0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1152, "1.12 KB"), (1536, "1.50 KB"),
    (1024**2, "1.00 MB"), (5 * 1024**3, "5.00 GB"),
])
def test_sizes(spark, size, shown):
    assert spark.range(1).select(text.format_size(F.lit(size).cast("bigint"))).first()[0] == shown


def test_python_repr(spark):
    values = ["a", "it's", 'say "x"', "both ' and \"", "back\\slash", "new\nline\ttab", "\x00\x7f\xa0​", "é日本"]
    assert [r[0] for r in column(spark, values, text.python_repr(F.col("v")))] == [repr(v) for v in values]


def test_truncation_and_result(spark):
    cut = text.truncate_at_newline(F.col("v"), 10)
    assert [r[0] for r in column(spark, ["12345678\nabc", "12\n4567890abc", "short"], cut)] == ["12345678", "12\n4567890", "short"]
    values = ["x<result> a <END_FS> </result>y", " plain ", "b<END_FS>"]
    assert [r[0] for r in column(spark, values, text.extract_result(F.col("v")))] == ["a", "plain", "b"]


def test_write_preview_replaces_broken_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"ok\xff"),), (bytearray(b"x" * 600),)], "b binary")
    rows = [r[0] for r in df.select(text.write_preview(F.col("b"))).collect()]
    assert rows[0].data == "ok�" and rows[0].data_length == 3
    assert rows[1].data == "x" * 500 + "...[truncated]" and rows[1].data_length == 600


def test_paths(spark):
    values = ["", "a", "a/b.tar.gz", "d/.bashrc", "x/y/z.PY"]
    got = column(spark, values, paths.name(F.col("v")), paths.parent(F.col("v")), paths.depth(F.col("v")), paths.extension(F.col("v")))
    assert got == [("/", None, 0, ""), ("a", "", 1, ""), ("b.tar.gz", "a", 2, "gz"), (".bashrc", "d", 2, ""), ("z.PY", "x/y", 3, "py")]
    links = column(spark, ["/a/b", "x", "../y", "./z/../w"], paths.resolve(F.lit("d/e"), F.col("v")))
    assert [r[0] for r in links] == ["a/b", "d/e/x", "d/y", "d/e/w"]


def test_prompts(spark):
    values = ["<W>\nmkdir('/a')\n---\n<x>", "", "<R>\n\n  Read('/a') \n", "Operation: Chmod ('/a')\n", "Operation: touch x\n"]
    got = column(spark, values, prompts.operation_line(F.col("v")), prompts.legacy_operation(F.col("v")))
    assert got == [("mkdir('/a')", "unknown"), ("", "unknown"), ("Read('/a')", "unknown"), ("Operation: Chmod ('/a')", "chmod"), ("Operation: touch x", "touch")]
    chosen = column(spark, values, prompts.with_contract(F.col("v")).contains("exact file content"))
    assert [r[0] for r in chosen] == [False, False, True, False, False]


def py_similarity(p, e):
    if not p and not e:
        return 1.0
    if not p or not e:
        return 0.0
    a, b = " ".join(p.split()), " ".join(e.split())
    if a == b:
        return 1.0
    x, y = set(a.lower()), set(b.lower())
    return len(x & y) / len(x | y)


def test_similarity_model(spark):
    values = ODD + [None, "ABC", "abc", "Straße", "İx"]
    pairs = [(p, e) for p in values for e in values]
    df = spark.createDataFrame([(i, p, e) for i, (p, e) in enumerate(pairs)], "i int, p string, e string")
    rows = cleaning.with_similarity(df, "p", "e").orderBy("i").collect()
    for (p, e), row in zip(pairs, rows):
        assert row.similarity == pytest.approx(py_similarity(p, e)), (p, e)


CLEANING = [
    ("<think>a</think> /tree\n", "/tree", "/tree"),
    ("hello <filesystem>x</filesystem> tail", "<filesystem>y</filesystem>\n<END_FS>", "<filesystem>x</filesystem>"),
    ("<filesystem>open", "<filesystem>y</filesystem>", "<filesystem>open"),
    ('["..", ".", "b"]', '[".","..","b"]', '[".","..","b"]'),
    ('x ["q"] ["r"]', '["z"]', '["q"]'),
    ("['a']", '["a"]', "['a']"),
    ("anything", "  ", ""),
    ("the answer is 42, yes", "42", "42"),
    ("text\nanswer: no", "other", "text"),
    ("text answer: no[EOF]x", "other", "text answer: no"),
    ("<think>never closed", "x", ""),
    (None, "x", None),
    ("a\n <THINKing\nb", "zz", "a\nb"),
]


def test_cleaning_routes(spark):
    df = spark.createDataFrame([(i, p, e) for i, (p, e, _) in enumerate(CLEANING)], "i int, predicted string, expected string")
    got = [r.predicted for r in cleaning.with_clean_prediction(df).orderBy("i").collect()]
    assert got == [want for _, _, want in CLEANING]


def test_contents_depend_on_the_path_alone(spark):
    rows = [(f"d/f{i}.{ext}",) for i in range(120) for ext in ("py", "json", "md")] + [(None,)]
    df = spark.createDataFrame(rows + rows[:50], "path string")
    got = {}
    for r in names.with_content(df, "path", "content").collect():
        assert got.setdefault(r.path, r.content) == r.content
    assert got.pop(None) is None and all(len(c) > 100 or p.endswith(("json", "md")) for p, c in got.items())
    starts = {ext: {c.split()[0] for p, c in got.items() if p.endswith(ext)} for ext in ("py", "json", "md")}
    assert {"from", "class", "#!/bin/sh", "package", "///"} == starts["py"] and {"{", "---", ";"} < starts["json"] and {"The", "For"} < starts["md"]
    for content in (c for p, c in got.items() if c.startswith("{")):
        assert {"place", "open", "remarks"} <= set(json.loads(content))
    short = names.with_content(df, "path", "content", max_chars=60).filter("path IS NOT NULL").first()
    assert len(short.content) < len(got[short.path])
