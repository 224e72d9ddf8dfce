"""Files, streams and user functions."""

import json

from pyspark.sql import functions as F
from pyspark.sql.datasource import StringStartsWith

from optrace import schema
from optrace.operators import infer, scoring
from optrace.sources import files, tree
from optrace.streaming import live

LOG = [
    {"operation": "mkdir", "path": "/d", "timestamp": 1.5, "parameters": {"mode": "0o755"}},
    {"operation": "flush", "path": "/d/f", "timestamp": 1.6, "parameters": {}},
    {"operation": "create", "path": "/d/f", "timestamp": 1.7, "parameters": {"mode": "0o100644", "fh": None}},
    {"operation": "write", "path": "/d/f", "timestamp": 1.8, "parameters": {"data": "hi", "data_length": 2, "offset": 0}},
    {"operation": "unlink", "path": "/nope", "timestamp": 1.9, "parameters": {}},
]


def write_log(folder):
    folder.mkdir(exist_ok=True)
    (folder / "s1.log").write_text("\n".join([json.dumps(x) for x in LOG[:2]] + ["", "{broken"] + [json.dumps(x) for x in LOG[2:]]) + "\n")


def test_trace_scan(spark, tmp_path):
    write_log(tmp_path / "logs")
    rows = files.read_trace(spark, str(tmp_path / "logs")).orderBy("seq").collect()
    assert [r.operation for r in rows] == ["mkdir", "create", "write", "unlink"]
    assert rows[1].parameters == {"mode": "0o100644", "fh": None}
    assert files.read_trace(spark, str(tmp_path / "absent")).isEmpty()


def test_validated_load(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"prompt": "a", "completion": "b"}\n{"prompt": "a"}\n{oops\n')
    good, bad = files.read_validated(spark, str(path))
    assert [tuple(r) for r in good.collect()] == [("a", "b")]
    assert sorted(r.reason for r in bad.collect()) == ["Invalid JSON", "Missing field"]


def test_pair_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("1", "p\né", "c"), ("2", "q", "d")], schema.PAIRS)
    target = files.write_pairs(pairs, str(tmp_path))
    assert "/fuse_2_" in target
    assert {tuple(r) for r in files.read_pairs(spark, target).collect()} == {("p\né", "c"), ("q", "d")}
    files.write_split(pairs.withColumn("split", F.lit("train")), str(tmp_path / "split"))
    assert (tmp_path / "split" / "split=train").is_dir()
    scored = scoring.score(pairs.selectExpr("example_id", "prompt AS expected", "prompt AS predicted"))
    report = files.write_report(scoring.summarize(scored), scored, str(tmp_path / "report"))
    assert spark.read.json(f"{report}/summary").first().total_examples == 2


def test_tree_scan(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "home" / "user").mkdir(parents=True)
    (root / "home" / "user" / "doc.txt").write_text("hello")
    (root / "bin.dat").write_bytes(b"\xff\xfe")
    (root / ".env").write_text("x" * 5000)
    (root / "_hid").mkdir(mode=0o750)
    (root / "home" / "up").symlink_to(root)
    rows = {r.path: r for r in files.scan_tree(spark, str(root)).collect()}
    assert set(rows) == {"", "home", "home/user", "home/user/doc.txt", "bin.dat", ".env", "_hid", "home/up"}
    assert rows[".env"].content == "x" * 5000 and rows["_hid"].is_dir and rows["_hid"].mode == 0o750 and not rows["home/up"].is_dir
    small = {r.path: r for r in files.scan_tree(spark, str(root), content_limit=10).collect()}
    assert small[".env"].content is None and small[".env"]["size"] == 5000 and small["home/user/doc.txt"].content == "hello"
    assert rows["home/user/doc.txt"].content == "hello" and rows["bin.dat"].content is None and rows[""].name == "/"


def test_xml_files(spark, tmp_path):
    document = (
        '<filesystem><directory path="/" name="/" mode="755" owner="root" group="root" mtime="2025-01-01T00:00:00">'
        '<directory path="etc" name="etc" mode="750"><file path="etc/p &amp; q" name="p &amp; q" mode="644" owner="root" group="root" '
        'mtime="2025-01-01T00:00:01" size="5"><body> a\nb </body></file></directory><file path="e" /></directory></filesystem>'
    )
    (tmp_path / "a.xml").write_text(document)
    (tmp_path / "b.xml").write_text("<other><file path='x'/></other>")
    entries, rejects = files.read_snapshots_xml(spark, str(tmp_path / "*.xml"))
    rows = {r.path: r for r in entries.collect()}
    assert set(rows) == {"", "etc", "etc/p & q", "e"}
    assert rows["etc/p & q"].content == " a\nb " and rows["etc"].mode == 0o750 and rows["e"].mode == 0o755 and rows["e"].content == ""
    assert [r.snapshot_id.rsplit("/")[-1] for r in rejects.collect()] == ["b.xml"]


def test_prediction_batches_and_errors(spark):
    def fn(texts):
        assert len(texts) <= 3
        if any("boom" in t for t in texts):
            raise RuntimeError("no backend")
        return [t[-2:] + "<END_FS>x" for t in texts]

    df = spark.createDataFrame([(str(i), f"p{i}") for i in range(7)], "example_id string, prompt string").coalesce(1)
    rows = infer.predict(df, fn, batch_size=3).collect()
    assert {r.example_id: r.predicted for r in rows} == {str(i): f"p{i}" for i in range(7)}
    failed = infer.predict(df.limit(1).withColumn("prompt", F.lit("boom")), fn, contract=None).first()
    assert failed.predicted is None and failed.error == "no backend"


def test_live_state_and_counts(spark, tmp_path):
    write_log(tmp_path / "logs")
    live.use_rocksdb(spark)
    ops = live.stream_trace(spark, str(tmp_path / "logs"))
    counts = live.live_distribution(ops).writeStream.outputMode("update").format("memory").queryName("counts").option(
        "checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counts").collect()} == {("mkdir", 1), ("create", 1), ("write", 1), ("unlink", 1)}
    state = live.live_state(ops).writeStream.outputMode("update").format("memory").queryName("state").option(
        "checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    state.awaitTermination(120)
    rows = {(r.operation, r.path): r for r in spark.table("state").collect()}
    assert rows["write", "d/f"].content == "hi" and rows["write", "d/f"]["size"] == 2
    assert not rows["unlink", "nope"].ok and rows["unlink", "nope"].reason == "missing"


def test_line_numbers_over_splits(spark, tmp_path):
    """Files of several splits, and several files in a task: numbers are the lines' places in their file."""
    wanted = {}
    for name, n in (("a", 3000), ("b", 7), ("c", 0), ("d", 900)):
        lines = [("x" * (i * 37 % 90)) + f" {i}" if i % 11 else "" for i in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
        wanted.update({(name, i + 1): x for i, x in enumerate(lines)})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("4000", "30000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = files.numbered_lines(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert len(rows) == len(wanted) and {(r.file.rsplit("/", 1)[-1], r.line): r.value for r in rows} == wanted
    (tmp_path / "pairs").write_text('{"prompt": "p", "completion": "c"}\n{"prompt": "p"}\n\nno json\n')
    good, rejects = files.read_validated(spark, str(tmp_path / "pairs"))
    assert good.count() == 1 and sorted((r.line, r.reason) for r in rejects.collect()) == [(2, "Missing field"), (3, "Invalid JSON"), (4, "Invalid JSON")]


def test_tree_source(spark, tmp_path):
    entries = [("a/b/one.txt", False, "é1"), ("a/two", False, ""), ("empty", True, None), ("a/c", True, None), (".dot/x", False, "x" * 50), ("z", False, None)]
    n = tree.write_tree(spark.createDataFrame(entries, "path string, is_dir boolean, content string").repartition(3), str(tmp_path / "t"))
    assert n == len(entries)
    (tmp_path / "t" / "a" / "raw").write_bytes(b"\xff\xfe")
    found = tree.read_tree(spark, str(tmp_path / "t"))
    rows = {r.path: r for r in found.collect()}
    assert set(rows) == {"", "a", "a/b", "a/b/one.txt", "a/two", "a/c", "empty", ".dot", ".dot/x", "z", "a/raw"}
    assert (rows["a/b/one.txt"].content, rows["a/b/one.txt"].size, rows["a/raw"].content, rows[""].name) == ("é1", 3, None, "/")
    columns = ["path", "name", "is_dir", "mode", "owner", "group", "size", "content"]
    walked = files.scan_tree(spark, str(tmp_path / "t")).select(columns).collect()
    assert {tuple(r) for r in walked} == {tuple(r[c] for c in columns) for r in rows.values()}
    assert {r.path for r in found.filter("path LIKE 'a/b%'").collect()} == {"a/b", "a/b/one.txt"}
    assert [r.path for r in found.filter("path = 'a/two'").collect()] == ["a/two"] and found.filter("path = 'none/x'").count() == 0
    assert tree.read_tree(spark, str(tmp_path / "t"), content_limit=10).filter("path = '.dot/x'").first().content is None


def test_tree_source_lists_only_what_may_match(tmp_path):
    for name in ("a/b/f", "a/c/f", "d/e/f"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    reader = tree.TreeReader({"root": str(tmp_path)})
    list(reader.pushFilters([StringStartsWith(("path",), "a/b")]))
    listed = []
    inside = tree.Store.inside
    tree.Store.inside = lambda self, folder: listed.append(folder) or inside(self, folder)
    try:
        parts = reader.partitions()
        found = {p for part in parts for batch in reader.read(part) for p in batch.column("path").to_pylist()}
    finally:
        tree.Store.inside = inside
    assert "a/b/f" in found and "d/e/f" not in found and set(listed) == {"", "a", "a/b"}


def test_counts_survive_a_restart(spark, tmp_path):
    """A second run goes on where the first ended; a batch that comes again replaces itself."""
    logs, kept, checkpoint = (str(tmp_path / x) for x in ("logs", "kept", "checkpoint"))
    write_log(tmp_path / "logs")
    counts = lambda: live.live_distribution(live.stream_trace(spark, logs))
    live.write_counts(counts(), kept, checkpoint)
    once = {tuple(r) for r in live.read_counts(spark, kept).collect()}
    live.write_counts(counts(), kept, checkpoint)  # nothing new
    assert {tuple(r) for r in live.read_counts(spark, kept).collect()} == once == {("mkdir", 1), ("create", 1), ("write", 1), ("unlink", 1)}
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda x: int(x.name))
    commits[-1].unlink()  # as if the run had ended before it could commit
    for crc in (tmp_path / "checkpoint" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    (tmp_path / "logs" / "more.jsonl").write_text('{"operation": "mkdir", "path": "/e", "timestamp": 9.5, "parameters": {}}\n')
    live.write_counts(counts(), kept, checkpoint)
    assert {tuple(r) for r in live.read_counts(spark, kept).collect()} == {("mkdir", 2), ("create", 1), ("write", 1), ("unlink", 1)}


def test_pairs_are_counted_while_written(spark, tmp_path):
    """One job writes; the plan does not run twice."""
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for x in batches:
            runs.add(len(x))
            yield x

    pairs = spark.range(50).selectExpr("CAST(id AS string) AS prompt", "'c' AS completion").repartition(3).mapInPandas(seen, "prompt string, completion string")
    assert "/fuse_50_" in files.write_pairs(pairs, str(tmp_path)) and runs.value == 50


def test_first_failures(spark):
    rows = [(f"{i:03}", "e" * 200, "p", i / 100, i % 3 == 0) for i in range(50)]
    scored = spark.createDataFrame(rows, "example_id string, expected string, predicted string, similarity double, correct boolean").repartition(7)
    found = scoring.failures(scored, 4).collect()
    assert [r.example_id for r in found] == ["001", "002", "004", "005"] and {r.failure_count for r in found} == {33} and len(found[0].expected_preview) == 100
    assert scoring.failures(scored.filter("correct"), 4).count() == 0
