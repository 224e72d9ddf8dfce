"""Line dedup, licence scan and token rollups: plain versions, plans without Python, recovery."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from optrace.llm import licenses, line_dedup, token_counts
from optrace.llm.common import shared_folder

LINES = [
    (1, "a", "head\none\nfoot"), (2, "a", "head\ntwo\nfoot"), (3, "a", "head\nthree\n\n"), (4, "a", "four"), (5, "a", "head\none\nfoot"),
    (5, "a", "head\none\nfoot"), (6, "b", "head\nx"), (7, "b", "head\nhead\ny"), (8, None, "head"), (9, "a", None), (10, "a", ""), (None, "a", "head\nlast"), (11, "c", "head"),
]


def plain(rows, ratio, least):
    pages = {(s, t) for _, s, t in rows if s is not None and t is not None}
    total = Counter(s for s, _ in pages)
    held = Counter((s, x) for s, t in pages for x in set(t.split("\n")) if x)
    out = []
    for i, s, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (held[s, x] >= least and held[s, x] > ratio * total[s])]
        out.append((i, s, None if t is None else "\n".join(kept), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ratio,least", [(0.3, 2), (0.1, 3), (0.9, 1), (0.0, 1)])
def test_lines(spark, ratio, least):
    frame = spark.createDataFrame([(*x, 9) for x in LINES], "doc_id long, source string, text string, n_dropped long")
    got = line_dedup.drop_boilerplate(frame, ratio=ratio, least_pages=least)
    assert got.columns == ["doc_id", "source", "text", "n_dropped"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(LINES, ratio, least)
    assert line_dedup.drop_boilerplate(frame.limit(0)).count() == 0


def test_columns_of_like_names_stay(spark):
    rows = [(*x, 1, "b", 3.0) for x in LINES]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, _p1 long, _P2 string, _hits double")
    got = line_dedup.drop_boilerplate(frame, ratio=0.3, least_pages=2)
    assert got.columns == [*frame.columns, "n_dropped"]
    assert sorted(((*x[:3], x[6]) for x in got.collect()), key=str) == plain(LINES, 0.3, 2) and {tuple(x[3:6]) for x in got.collect()} == {(1, "b", 3.0)}


def test_planted_lines_of_a_large_site(spark):
    """Lines on 1, 3 and 9 % of 2,000 pages go; lines on up to 0.5 % of them, or on four pages, stay."""
    planted = {"one": 20, "three": 60, "nine": 180, "rare": 10, "four": 4}
    rows = [(i, "large", "\n".join([f"text {i}", *(x for x, n in planted.items() if i < n), f"end {i}"])) for i in range(2000)]
    rows += [(9000 + i, "small", f"own {i}" + ("\nfour" if i < 4 else "") + ("\nfive" if i < 5 else "")) for i in range(40)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    left = Counter((x.source, line) for x in got for line in x.text.split("\n") if not re.search(r"\d", line))
    assert left == {("large", "rare"): 10, ("large", "four"): 4, ("small", "four"): 4}
    assert sum(x.n_dropped for x in got) == 20 + 60 + 180 + 5
    assert sum(len(re.findall(r"(?:text|end|own) \d", x.text)) for x in got) == 4040


def no_python(frame):
    return not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())


def test_native_plans(documents, spark):
    assert no_python(line_dedup.drop_boilerplate(documents))
    known = licenses.known_digests(spark)
    assert no_python(licenses.license_scan(documents, known.select("digest", "license")).drop("license"))


def test_licenses(spark):
    mit = licenses.MIT_GRANT
    texts = [
        (1, mit, "MIT"), (2, "Copyright (c) 2024 Someone\n\n" + mit.replace('"Software"', "'software'").upper(), "MIT"), (3, mit + " More.", None),
        (4, "MIT License\r\n\r\nCopyright 2001 A\r\n" + mit.replace(". ", ".\r\n"), "MIT"), (5, None, None), (6, "", None), (7, "(c) me\n***", None),
        (8, licenses.ISC_GRANT.replace("license", "licence"), "ISC"), (1, mit, "MIT"), (None, mit, "MIT"), (9, "x" * 200_000, None),
    ]
    frame = spark.createDataFrame([(i, t, "l") for i, t, _ in texts], "doc_id long, text string, license string")
    rows = licenses.license_scan(frame, licenses.known_digests(spark)).collect()
    assert Counter((x.doc_id, x.license) for x in rows) == Counter((i, n) for i, _, n in texts)
    assert {x.doc_id for x in rows if x.digest is None} == {5}


def shipped(name):
    from importlib import resources

    return resources.files("optrace.llm").joinpath(f"license_texts/{name}.txt").read_text("utf-8")


def test_whole_texts_of_common_licenses(spark):
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-2-Clause", "BSD-3-Clause"]
    texts = [(i, shipped(n), n) for i, n in enumerate(names)]
    bsd = shipped("BSD-3-Clause").replace("the copyright holder nor", "Some Company, Inc. nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE OWNERS")
    texts += [
        (20, "Copyright (c) 2011, Some Company\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause"), (21, "BSD 2-Clause License\n\n" + shipped("BSD-2-Clause"), "BSD-2-Clause"),
        (22, shipped("MPL-2.0").replace("authorized", "authorised").replace("License", "Licence"), "MPL-2.0"),
        (23, "# " + "\n# ".join(shipped("Apache-2.0").replace("[yyyy] [name of copyright owner]", "2020 Someone").split("\n")), "Apache-2.0"),
        (24, licenses.ISC_GRANT.replace("the above copyright", "the above\ncopyright"), "ISC"), (25, "Copyright 2020 A\n" + licenses.ISC_GRANT, "ISC"),
        (26, shipped("GPL-3.0").split("How to Apply These Terms")[0], "GPL-3.0"), (27, shipped("GPL-2.0")[:9000], None),
    ]
    frame = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    rows = licenses.license_scan(frame, licenses.known_digests(spark)).collect()
    assert {x.doc_id: x.license for x in rows} == {i: n for i, _, n in texts}


def test_passages(spark):
    rows = [
        (1, "intro\n\nReleased under the MIT License.\n\nmore"), (2, "intro\nLicensed under CC BY-NC 4.0.\nReleased under the MIT license\nmore"), (3, "none"), (4, None),
        (5, "A text.\r\n\r\n" + licenses.ISC_GRANT.replace(". THE", ".\r\nTHE") + "\r\n\r\nIts end."), (6, licenses.MIT_GRANT), (6, licenses.MIT_GRANT),
    ]
    got = licenses.license_passages(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_digests(spark))
    assert no_python(licenses.license_passages(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"), spark.sql("SELECT 'd' AS digest, 'l' AS license")))
    assert sorted(map(tuple, got.collect())) == [(1, "MIT", 1), (2, "CC-BY-NC-4.0", 1), (2, "MIT", 1), (5, "ISC", 1), (6, "MIT", 1), (6, "MIT", 1)]


def counts(spark, rows):
    return spark.createDataFrame([(*x, "extra") for x in rows], "source string, lang string, version string, n_tokens long, documents string")


def totals(rollup):
    return {(x.source, x.lang, x.version): (x.documents, x.tokens) for x in rollup.totals().collect()}


def test_rollup(spark):
    rollup = token_counts.Rollup(spark, shared_folder(spark, "test"))
    assert totals(rollup) == {}
    first = counts(spark, [("a", "en", "1", 5), ("a", "en", "1", 7), ("b", None, "1", 1), (None, None, None, None)])
    assert rollup.commit("one", token_counts.inserts(first))
    assert not rollup.commit("one", token_counts.inserts(first))
    assert rollup.commit("a/b %", token_counts.revisions(counts(spark, [("a", "en", "1", 5)]), counts(spark, [("a", "en", "2", 4)])))
    assert rollup.commit("gone", token_counts.deletes(counts(spark, [("b", None, "1", 1)])))
    want = {("a", "en", "1"): (1, 7), ("a", "en", "2"): (1, 4), (None, None, None): (1, 0)}
    assert totals(rollup) == want
    rollup.compact()
    assert totals(rollup) == want and not rollup.commit("one", token_counts.inserts(first))
    assert rollup.commit("more", token_counts.inserts(counts(spark, [("a", "en", "2", 6)])))
    rollup.compact()
    assert totals(rollup) == want | {("a", "en", "2"): (2, 10)}
    assert rollup.commit("empty", token_counts.inserts(first.limit(0))) and totals(rollup)[("a", "en", "2")] == (2, 10)


def test_broken_commit_is_written_anew(spark):
    folder = shared_folder(spark, "test")
    rollup = token_counts.Rollup(spark, folder)
    rows = token_counts.inserts(counts(spark, [("a", "en", "1", 5)]))
    rows.write.parquet(f"{folder}/batch-one")
    rollup.files.delete(rollup._path("batch-one/_SUCCESS"), False)
    assert totals(rollup) == {}
    assert rollup.commit("one", rows) and totals(rollup) == {("a", "en", "1"): (1, 5)}


def test_counted(spark):
    rows = [(None,), ("",), (" a  b\tc\n",), ("don't 42 é!",)]
    frame = spark.createDataFrame(rows, "text string")
    got = [tuple(x) for x in frame.select(*[token_counts.counted(F.col("text"), v) for v in ("words-1", "pieces-1")]).collect()]
    assert got == [(0, 0), (0, 0), (3, 3), (3, 7)]
