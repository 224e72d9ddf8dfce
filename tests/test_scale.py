"""Steps that grow with the tables: parts of files, numbered n-grams, scoring without repeated searches."""

import gc
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from optrace import schema
from optrace.functions import cleaning, text
from optrace.functions.text import BLANK_CHARS, fold_blanks
from optrace.operators import compress, dataset, replay, scoring, synth
from optrace.plans import views
from optrace.sources import files


def test_xml_parts(spark, tmp_path):
    """A snapshot in part files of few elements is read as one; only a folder without a root is refused."""
    rows = [("s", 0, None, "<filesystem>"), ("s", 1, "a", '<directory path="/" name="/">')]
    rows += [("s", 1, f"b{i:02d}", f'<file path="f{i}" name="f{i}" size="1"><body>x\ny{i}</body></file>') for i in range(25)]
    rows += [("s", 1, "c", "</directory>"), ("s", 2, None, "</filesystem>"), ("t", 1, "a", '<file path="g" />')]
    fragments = spark.createDataFrame(rows, "snapshot_id string, place int, sort_key string, text string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_snapshots_xml(fragments, str(tmp_path / "xml"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "xml" / "state=s").glob("part-*"))
    assert len(parts) > 1 and "".join(p.read_text() for p in parts) == "".join(x[3] + files.PART_BREAK for x in rows[:-1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # elements across splits
    entries, rejects = files.read_snapshots_xml(spark, str(tmp_path / "xml"), parts=True)
    found, refused = {r.path: r for r in entries.collect()}, rejects.collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert set(found) == {""} | {f"f{i}" for i in range(25)} and found["f7"].content == "x\ny7"
    assert [(r.snapshot_id.rstrip("/").rsplit("/")[-1], r.reason) for r in refused] == [("state=t", "Expected <filesystem> root element")]


TEXTS = ["a b a b a", "", None, f"　x{BLANK_CHARS}y\x85x ", "<START> a", "é ü é", "word"]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_coded_counts(spark, monkeypatch, n):
    """The same counts as ngram_counts, one number a word; ids may repeat or lack."""
    docs = spark.createDataFrame([(i if i < 5 else None, "g", t) for i, t in enumerate(TEXTS)], "doc_id long, lang string, text string").coalesce(2)
    plain = compress.ngram_counts(docs, n, keep=["doc_id", "lang"]).groupBy("doc_id", "lang", "context", "token").agg(F.sum("times")).collect()
    coded = compress.coded_counts(docs, n, keep=["doc_id", "lang"]).groupBy("doc_id", "lang", "gram").agg(F.sum("times")).collect()
    assert Counter((r[0], r[1], r[4]) for r in plain) == Counter((r[0], r[1], r[3]) for r in coded)
    assert len({r[2:4] for r in plain}) == len({str(r[2]) for r in coded})


def test_blocks_leave_nothing_behind(monkeypatch):
    """A worker holds the words of one block, not those of all it has read."""
    monkeypatch.setattr(compress, "BLOCK_TOKENS", 4)
    gc.collect()
    gc.disable()
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([f"x{i} y{i} x{i} z w" for i in range(100)])], ["text"])
        blocks = [b.column("words")[0].as_py() for b in compress._read_blocks(iter([batch]))]
        held = [x for x in gc.get_objects() if isinstance(x, defaultdict) and "<START>" in x]
    finally:
        gc.enable()
    assert len(blocks) == 100 and blocks[7] == ["<START>", "x7", "y7", "z", "w"]
    assert not held


def test_blocks_are_written_one_by_one(spark, monkeypatch):
    """Neither a writer nor a reader holds more than a block: each has a row group of its own."""
    kept, written = compress.kept, {}

    def keep(df, name, *more):
        written[name] = kept(df, name, *more)
        return written[name]

    monkeypatch.setattr(compress, "kept", keep)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, 3)
    try:
        docs = spark.createDataFrame([(i, f"a b{i}") for i in range(60)], "doc_id long, text string").coalesce(1)
        compress.coded_counts(docs)
    finally:
        spark.conf.unset(conf)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in written["blocks"].inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert len(groups) == 20 and set(groups) == {1}


@pytest.mark.parametrize("group", [None, "lang"])
def test_own_ratio_is_estimate_under_own_model(spark, group):
    docs = spark.createDataFrame([(i, "uv"[i % 2], f"{t} q") for i, t in enumerate(TEXTS)], "doc_id long, lang string, text string")
    one = {r.doc_id: (r.num_tokens, round(r.bits, 9)) for r in compress.own_ratio(docs, 2, group=group).collect()}
    model = compress.fit_ngram(docs, 2, group=group)
    assert one == {r.doc_id: (r.num_tokens, round(r.bits, 9)) for r in compress.estimate_ratio(docs, model, 2, group=group).collect()}


def test_fold_blanks(spark):
    texts = [" a  b", "a\tb c", "a \n b\x85c ", "a b", "", "　", "a!~b"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold_blanks(F.col("t")).alias("f")).collect()
    assert all(r.f == " ".join(r.t.split()) for r in found)


def test_state_is_searched_once(spark):
    """The plan has one search for the state document, not one for each place that uses its result."""
    df = spark.createDataFrame([("1", "x <filesystem>aä1</filesystem> y", "<filesystem>AB</filesystem>\n<END_FS>"), ("2", "no", "<filesystem>é")], "example_id string, predicted string, expected string")
    scored = scoring.score(df)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<filesystem.*?") + plan.count(", <filesystem)") <= 1
    rows = {r.example_id: r for r in scored.collect()}
    assert rows["1"].predicted == "<filesystem>aä1</filesystem>" and rows["2"].predicted == "no"
    one, two = set(rows["1"].predicted), set("<filesystem>ab</filesystem>")
    assert abs(rows["1"].similarity - len(one & two) / len(one | two)) < 1e-12


def _tree(snap, *files):
    rows = [(snap, "", "/", True, 0o755, "root", "root", 0.0, 0, None)]
    return rows + [(snap, p, p, False, 0o644, "root", "root", 0.0, len(c), c) for p, c in files]


def test_examples_read_the_log_once(spark):
    """The given log is worked out in one pass, whatever is built from it; states too long by their number of
    entries or by one body are left out, on the side where they are."""
    start = _tree("a", ("f", "x")) + _tree("b", *[(f"f{i}", "") for i in range(60)]) + _tree("c", ("f", "y" * 5000)) + _tree("d", ("f", "<z>"))
    log = [("a", 1, "chmod", "/f", {"mode": "0o600"}), ("b", 1, "unlink", "/f1", {}), ("c", 1, "read", "/f", {}), ("d", 1, "read", "/f", {}),
           ("d", 2, "getattr", "/f", {}), ("a", 0, "create", "/n/m", {})]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    ops = spark.createDataFrame([(s, i, o, p, None, m) for s, i, o, p, m in log], schema.OPS).mapInArrow(count, schema.OPS)
    examples = dataset.build_examples(spark.createDataFrame(start, schema.ENTRIES), ops, max_tokens=1000).collect()
    assert seen.value == len(log)
    got = {r.session: r for r in examples}
    assert set(got) == {"a", "d"} and got["d"].result == "<z>" and "<body>&lt;z&gt;</body>" in got["d"].initial_state
    assert 'mode="644"' in got["a"].initial_state and 'mode="600"' in got["a"].result


def test_short_paths_take_one_exchange(spark):
    """Only paths with more operations than width are cut in ranges; the rows are the same either way."""
    start = spark.createDataFrame(_tree("s", ("f", "abc"), ("g", "")), schema.ENTRIES)
    kinds = [("write", {"data_length": "7"}), ("unlink", {}), ("create", {"mode": "0o640"}), ("truncate", {"length": "2"}), ("chmod", {"mode": "0o600"})]
    log = [("s", 100 * i, *(kinds[i * 3 % 5][0], "/" + "fgh"[i % 3]), None, kinds[i * 3 % 5][1]) for i in range(20)] + [(None, 5, "unlink", "/f", None, {})]
    ops = spark.createDataFrame(log, schema.OPS)
    (whole, _), (cut, _) = replay.fold_files(start, ops, 100), replay.fold_files(start, ops, 3)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (whole, cut)]
    assert "_range" in plans[1] and "_range" not in plans[0] and plans[0].count("Scan ExistingRDD") <= 4
    rows = [sorted(map(str, df.collect())) for df in (whole, cut)]
    assert rows[0] == rows[1] and len(rows[0]) > 20


def test_users_are_not_put_together(spark, tmp_path):
    spark.range(300).selectExpr("id AS user_id").write.parquet(str(tmp_path / "events.parquet"))
    entries = views.event_initial(spark, str(tmp_path)).filter("NOT is_dir")
    assert entries.count() == 300 * 50
    assert entries.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("make", [synth.random_ops, synth.targeted_ops])
def test_entries_are_never_broadcast(spark, tmp_path, make):
    """Entries exploded from few users seem small; what is looked up in them is merged."""
    spark.range(30).selectExpr("IF(id = 7, NULL, id) AS user_id").write.parquet(str(tmp_path / "events.parquet"))
    ops = make(views.event_initial(spark, str(tmp_path)), "7")
    assert len({r.session for r in ops.collect()}) > 20
    plan = ops._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


ODD = ["a", "", " ", " a", "a ", "\ta b\n", "\x85a　", "　", "é", "é ", "~!", "a\x7f", "x  y", "x \ny", "x y", "a\x85b", "  ", "\x1f!"]


def test_cheap_steps_of_scoring(spark):
    """Trims of texts that begin and end with printable characters, tests before patterns: the same results."""
    df = spark.createDataFrame([(t,) for t in ODD] + [(None,)], "t string")
    c = F.col("t")
    for r in df.select("t", text.strip_plain(c).alias("s"), text.strip_right_plain(c).alias("r"), fold_blanks(c, text.strip_plain(c)).alias("f")).collect():
        assert (r.s, r.r, r.f) == ((None,) * 3 if r.t is None else (r.t.strip(), r.t.rstrip(), " ".join(r.t.split())))
    plan = df.select(text.strip_plain(c))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and "cast(t" in plan

    answers = ["x", "x [eof] y", "x\nanSWer: y", "x answer: y", "Explanation: y", "a:[b", " x ", "<b>", "<ThinK>a</think>b", "a\r<think", "a\x85b", "<this", None]
    said = spark.createDataFrame([(t,) for t in answers], "t string")
    got = [tuple(r) for r in said.select(cleaning.strip_think(c), cleaning.strip_chatter(c)).collect()]
    assert [g[0] for g in got] == ["x", "x [eof] y", "x\nanSWer: y", "x answer: y", "Explanation: y", "a:[b", "x", "<b>", "b", "a", "a\nb", "<this", None]
    assert [g[1] for g in got] == ["x", "x", "x", "x answer: y", "", "a:[b", "x", "<b>", "<ThinK>a</think>b", "a\r<think", "a\x85b", "<this", None]
    begins = [" /a", "/a", "<filesystem", "\x85<filesystem x", "a/", "", " ", "é/", None]
    states = spark.createDataFrame([(t,) for t in begins], "t string").select(cleaning.is_state(c)).collect()
    assert [r[0] for r in states] == [True, True, True, True, False, False, False, False, False]


def test_characters_of_both_cases(spark):
    """Similarity by lower-case characters, though only what is not frequent is put in lower case."""
    said = ["AbC dé", "abc", "ΟΔΟΣ x", "Kelvin", "İstanbul 9.", "\U0001f600 Ü", "ZZZ", "a  b", "aeinrst AEINRST"]
    both = [(a, b) for a in said for b in said]
    rows = cleaning.with_similarity(spark.createDataFrame(both, "predicted string, expected string"), "predicted", "expected").collect()
    for r in rows:
        p, e = (" ".join(x.split()) for x in (r.predicted, r.expected))
        one, two = set(p.lower()), set(e.lower())
        assert abs(r.similarity - (1 if p == e else len(one & two) / len(one | two))) < 1e-12, r


def test_trims_from_the_last_bytes(spark):
    """Only the end of a text is trimmed where that is enough: blanks and tokens on either side of the bytes looked at."""
    bodies = ["", "a", "é", "x" * 15, "x" * 16, "日本" * 30, "x" * 200, "é" * 31 + "x" * 3, " x", "<END_FS>" * 9]
    ends = ["", " ", "\x85", "　" * 5, " " * 55, "\u2028" * 20, " " * 64, " " * 200]
    said = [b + e + t + f for b in bodies for e in ends for t in ("", "<END_FS>") for f in ("", "\n", " " * 58, "　" * 30)]
    c = F.col("t")
    df = spark.createDataFrame([(t,) for t in said], "t string")
    got = df.select("t", text.strip_plain(c).alias("s"), text.strip_right_plain(c).alias("r"), cleaning.strip_stop_plain(c).alias("p"), cleaning.strip_stop(c).alias("q"))
    for r in got.collect():
        right = r.t.rstrip()
        want = right[:-8].rstrip() if right.endswith("<END_FS>") else right
        assert (r.s, r.r, r.p, r.q) == (r.t.strip(), right, want, want), repr(r.t)
    # The whole text is trimmed, and the blanks of all are looked for, only behind the test of the last bytes.
    plan = df.select(text.strip_right_plain(c))._jdf.queryExecution().optimizedPlan().toString()
    assert "-64, 64" in plan


def test_patterns_only_where_needed(spark):
    """Cleaning step by step gives what the steps give in one, and similarity folds no whitespace."""
    said = ["x", "<think>a</think>b", "<THINK>a\r\n</think> b\r\nc", "a\r<think b\x85c", "a\u2029\x1c<Thinking\nb", "<think>open", "x<t", "a\nAnswer: b", "answer: b",
            "\nexplanation: b", "a\n [EOF]", "a[eof]", "a\n\nEXPLANATION:", "ä\nanswer", "a\x0bAnswer: c", " <think> </think>Answer: x", "n: [b] r:", None]
    df = spark.createDataFrame([(t,) for t in said], "predicted string").withColumn("expected", F.lit("zz zz"))
    cleaned = cleaning.with_clean_prediction(df.withColumn("_whole", F.col("predicted")))
    rows = cleaned.withColumn("_want", cleaning.strip_think(F.col("_whole"))).withColumn("_want", cleaning.strip_chatter(F.col("_want"))).collect()
    assert len(rows) == len(said) and all(r.predicted == r._want for r in rows), [(r._whole, r.predicted, r._want) for r in rows if r.predicted != r._want]

    end, both = "</filesystem>", "<filesystem>a</filesystem>"
    states = [both, f"x {both} y", f"{both}{both}", f"{both} z {end}", "<filesystem>open \n", "no", end, f"{both}\n<END_FS>\n", "<filesystem> <END_FS>", "é<filesystem>é" + end, " ", ""]
    df = spark.createDataFrame([(s,) for s in states], "t string").select("t", F.col("t").alias("predicted"), F.lit("<filesystem>other").alias("expected"))
    for r in cleaning.with_clean_prediction(df).withColumn("want", cleaning.strip_stop(cleaning.extract_state(F.col("t")))).collect():
        assert r.predicted == r.want.strip(), r

    same = [("a  b", "a b\t"), ("a\n", "a"), (" ", "\t\n"), (" ", "a"), ("a\x85b", "a　b"), ("jqxz JQ", "jq xz"), ("\u212aj q", "kj　Q"), ("ΑΣ ΣΑ\nx", "ας σα X"), ("A.b", "a. B")]
    frame = spark.createDataFrame(same, "predicted string, expected string")
    scored = cleaning.with_similarity(frame, "predicted", "expected")
    for r in scored.collect():
        one, two = (set(" ".join(x.lower().split())) for x in (r.predicted, r.expected))
        assert abs(r.similarity - (len(one & two) / len(one | two) if one | two else 1)) < 1e-12, r
    assert "regexp_replace(CASE" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_state_documents_are_built_once(spark, tmp_path):
    rows = [(i, t, "en") for i, t in enumerate(["a<b>&c", "plain text of a body", "", None, "x&" * 30])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    states = views.state_predictions(spark, str(tmp_path))
    assert states._jdf.queryExecution().optimizedPlan().toString().count("<>&") == 1
    for r in states.collect():
        i = int(r.example_id)
        if rows[i][1] is None:
            assert r.expected is None and r.predicted is None
        else:
            state = f'<filesystem><file path="d{i}"><body>{rows[i][1].translate({ord(x): " " for x in "<>&"})}</body></file></filesystem>'
            assert r.expected == state + "\n<END_FS>"
            assert r.predicted == ["Here it is: " + state + " done", state + "\n<END_FS>\n", state[:-20]][i % 4]
