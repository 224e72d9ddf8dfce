"""Snapshots, rendering and replay on small fixtures and against plain models."""

import random
import xml.etree.ElementTree as ET
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from optrace import schema
from optrace.operators import dataset, render, replay, snapshot, synth, transition
from optrace.operators.grouping import below_boundary, boundary_of, ordered_groups
from optrace.sources import files

TIME = datetime(2023, 10, 27, 10, 0, tzinfo=timezone.utc).timestamp()


def entry(path, is_dir=True, mode=0o755, owner="root", size=0, content=None, snap="s"):
    return (snap, path, path.rsplit("/", 1)[-1] or "/", is_dir, mode, owner, owner, TIME, size, content)


def table(spark, rows):
    return spark.createDataFrame(rows, schema.ENTRIES)


def joined(fragments, separator=""):
    """The document that fragments of one snapshot make up."""
    rows = fragments.collect()
    return separator.join(r.text for r in sorted(rows, key=lambda r: (getattr(r, "place", 1), r.sort_key or [])))


# A tree of its own, drawn by hand.
DRAWN_ROWS = [
    entry(""), entry("lib", mode=0o700, owner="ops"), entry("lib/zone"), entry("lib/zone/map.bin", False, 0o600, "ops", 3072),
    entry("var", mode=0o775), entry("var/log.txt", False, 0o640, "www", 7),
]
DRAWN = """/                dir  755 root:root Oct 27 10:00
├── lib                          dir  700 ops:ops Oct 27 10:00
│   └── zone                     dir  755 root:root Oct 27 10:00
│       └── map.bin              file 600 ops:ops Oct 27 10:00 3.00 KB
└── var                          dir  775 root:root Oct 27 10:00
    └── log.txt                  file 640 www:www Oct 27 10:00 7 B"""


def test_drawn_tree(spark):
    assert joined(render.render_tree(table(spark, DRAWN_ROWS), include_contents=False), "\n") == DRAWN


def test_root_only_and_bodies(spark):
    assert joined(render.render_tree(table(spark, DRAWN_ROWS[:1])), "\n") == DRAWN.split("\n")[0]
    rows = [entry(""), entry("a", False, 0o644, size=6, content="x\n\ny\n"), entry("d"), entry("d/e", False, 0o644, size=0, content="")]
    lines = joined(render.render_tree(table(spark, rows)), "\n").split("\n")
    assert [line.split(" ")[0] for line in lines[:2]] == ["/", "├──"]
    assert lines[3:6] == ["│           │ <file_body path=\"d/e\">", "│           │ ", "│           │ </file_body>"]
    assert lines[-4:] == ["        │ <file_body path=\"a\">", "        │ x", "        │ y", "        │ </file_body>"]


def et_document(rows):
    """The same document built with the standard library."""
    by_path = {r[1]: r for r in rows}

    def add(path, above):
        r = by_path[path]
        attributes = {"path": path or "/", "name": r[2], "mode": f"{r[4]:o}", "owner": r[5], "group": r[6],
                      "mtime": "2025-01-01T00:00:00" if r[3] else "2025-01-01T00:00:01"}
        node = ET.SubElement(above, "directory" if r[3] else "file", attributes)
        if not r[3]:
            node.set("size", str(r[8]))
            if r[9] is not None and r[8] <= 4000:
                ET.SubElement(node, "body").text = r[9]
        for child in sorted(p for p in by_path if p and transition.parent_of(p) == path):
            add(child, node)

    root = ET.Element("filesystem")
    add("", root)
    return ET.tostring(root, encoding="unicode")


XML_ROWS = [
    entry(""), entry("a-b", False, 0o600, size=3, content="<&>"), entry("a"), entry("a/c", False, 0o644, 'q"\'&', 2, "\n\t"),
    entry("a/é\tz", False, 0o644, size=0, content=""), entry("a/empty"), entry("big", False, 0o644, size=5000, content="z" * 5000),
    entry("none", False, 0o644, size=9, content=None),
]


def test_xml_equals_standard_library(spark):
    assert joined(render.render_xml(table(spark, XML_ROWS))) == et_document(XML_ROWS)
    bare = render.render_xml(table(spark, XML_ROWS[:0]), snapshots=spark.createDataFrame([("e",)], "snapshot_id string"))
    assert joined(bare) == "<filesystem />"


def test_missing_attributes_stay_in_the_document(spark):
    rows = [entry(""), ("s", "f", None, False, None, None, None, None, None, None)]
    assert '<file path="f" name="" mode="" owner="" group=""' in joined(render.render_xml(table(spark, rows)))


def test_fragments_in_parts_are_whole(spark):
    rows = XML_ROWS + [entry(f"a/f{i:04d}", False, 0o644, size=4, content="body") for i in range(400)]
    inside = render.xml_fragments(table(spark, rows))
    parts = ordered_groups(inside, ["snapshot_id"], "sort_key", "text", 7).orderBy("part").collect()
    assert [p.part for p in parts] == list(range(parts[0].n_parts)) and {len(p["items"]) for p in parts[:-1]} == {7}
    assert "<filesystem>" + "".join(x for p in parts for x in p["items"]) + "</filesystem>" == et_document(rows)


def test_xml_round_trip(spark):
    visible = [r for r in XML_ROWS if r[1] != "big"]
    fragments = render.render_xml(table(spark, visible))
    whole = spark.createDataFrame([("s", joined(fragments))], "snapshot_id string, document string")
    want = {r[1]: (r[2], r[3], r[4], r[5], r[8], None if r[3] else r[9] or "") for r in visible}
    for entries, rejects in (files.entries_from_fragments(fragments), files.entries_from_xml(whole, "snapshot_id")):
        assert rejects.isEmpty()
        assert {r.path: (r.name, r.is_dir, r.mode, r.owner, r["size"], r.content) for r in entries.collect()} == want


def test_xml_as_others_write_it(spark):
    documents = [
        ("q", "<filesystem><file path='a&#233;' size='3'><body><![CDATA[a<b]]>&gt;</body></file><directory path=\"d\"/></filesystem>"),
        ("x", "<other/>"), ("y", "<filesystem><file"), ("z", ""), ("u", "<filesystem><file path='a'></filesystem>"),
        ("n", "<filesystem><file path='a' size='many'/><file path='b' size='1'/></filesystem>"),
    ]
    entries, rejects = files.entries_from_xml(spark.createDataFrame(documents, "snapshot_id string, document string"), "snapshot_id")
    assert {(r.snapshot_id, r.path, r.content) for r in entries.collect()} == {("q", "aé", "a<b>"), ("q", "d", None), ("n", "b", "")}
    assert {(r.snapshot_id, r.path) for r in rejects.collect()} == {("x", None), ("y", None), ("u", None), ("n", "a")}
    assert rejects.count() == 4


def test_queries_on_entries(spark):
    df = table(spark, XML_ROWS)
    asked = spark.createDataFrame([("s", p, o) for p in ("/", "/a", "/big", "/no") for o in ("readdir", "getattr", "read")],
                                  "snapshot_id string, path string, operation string")
    got = {(r.path, r.operation): r.answer for r in snapshot.answer_queries(df, asked).collect()}
    assert got["/a", "readdir"] == '[".","..","c","empty","\\u00e9\\tz"]'
    assert got["/big", "readdir"] == got["/no", "readdir"] == '[".",".."]'
    assert got["/", "getattr"].startswith('{"mode": 493, "size": 0, "type": "directory", "mtime": 1698400800.0, "owner": "root"')
    assert got["/a", "read"] == "ERROR: Is a directory" and got["/no", "read"] == "ERROR: No such file or directory"


def test_listing_parts_keep_every_name(spark):
    rows = [entry("")] + [entry(f"f{i:05d}", False, 0o644) for i in range(3000)]
    parts = snapshot.list_directories(table(spark, rows), names_per_row=250).orderBy("part").collect()
    names = [n for p in parts for n in __import__("json").loads(p.listing)]
    assert len(parts) > 5 and names == [".", ".."] + [f"f{i:05d}" for i in range(3000)]


def test_boundary_is_exact(spark):
    df = spark.range(5000).selectExpr("cast(id as string) AS example_id")
    key = dataset.split_key("example_id")
    for n in (0, 1, 777, 4999, 5000, 6000):
        assert df.filter(below_boundary(key, "example_id", boundary_of(df, n, key, "example_id"))).count() == min(n, 5000)
    rows = sorted(tuple(r) for r in df.select(key, "example_id").collect())
    for n in (1, 40, 2500, 4990, 5000):  # few rows are settled one by one, so the bracket is narrowed again and again
        for settled in (1, 60, 400):
            assert boundary_of(df, n, key, "example_id", settled) == rows[n - 1]
    equal = df.withColumn("k", F.lit(7).cast("bigint"))
    assert boundary_of(equal, 3, F.col("k"), "example_id", 10) == (7, sorted(r[1] for r in rows)[2])
    assert boundary_of(df, lambda n: n // 2, key, "example_id") == rows[2499] and boundary_of(df.limit(0), lambda n: n, key, "example_id") == (-1, None)


# Replay ------------------------------------------------------------------------------------

def op(seq, kind, path, session="s", **params):
    return (session, seq, kind, path, datetime(2024, 1, 1, tzinfo=timezone.utc), {k: str(v) for k, v in params.items()})


def model(initial, ops):
    """Everything of one session folded in order, without scopes."""
    store = transition.DictStore()
    store.put("", [True, 0o755, "root", "root", 0.0, 0, None])
    for e in initial:
        store.put(e[1], list(e[3:10]))
    failed = []
    for _, seq, kind, path, _, p in sorted(ops, key=lambda o: o[1]):
        new = p.get("new_path") or p.get("target")

        class Row:
            operation, mtime, data, uid, gid = kind, 0.0, p.get("data"), p.get("uid"), p.get("gid")
            mode = int(p["mode"], 8) & 0o7777 if "mode" in p else None
            offset, length, data_length = p.get("offset"), p.get("length"), p.get("data_length")
            new_path = new.strip("/") if new else None
        Row.path = path.strip("/")
        try:
            transition.apply(store, Row, False, False)
        except transition.Rejected:
            failed.append(seq)
    return {p: (e[0], e[1], e[5], e[6]) for p, e in store.entries.items() if p}, failed


def replayed(spark, initial, ops):
    start, log = table(spark, initial), spark.createDataFrame(ops, schema.OPS)
    folded = replay.folded(start, log).cache()
    state = {(r.snapshot_id, r.path): (r.is_dir, r.mode, r["size"], r.content) for r in replay.replay(start, log, folded).collect() if r.path}
    failed = {(r.session, r.seq) for r in replay.outcomes(folded).collect() if not r.ok}
    return state, failed


def test_end_to_end_sequence(spark):
    ops = [
        op(1, "mkdir", "/proj", mode="0o755"), op(2, "mkdir", "/proj/docs"), op(3, "create", "/proj/README.md"),
        op(4, "write", "/proj/README.md", data="hello world\n", data_length=12, offset=0),
        op(5, "rename", "/proj/README.md", new_path="/proj/README2.md"), op(6, "rmdir", "/proj"),
        op(7, "unlink", "/proj/README2.md"), op(8, "rmdir", "/proj/docs"), op(9, "unlink", "/nope"),
        op(10, "create", "/missing/x"), op(11, "write", "/proj", data="x", data_length=1),
    ]
    state, failed = replayed(spark, [entry("")], ops)
    assert state == {("s", "proj"): (True, 0o755, 0, None)}
    assert failed == {("s", 6), ("s", 9), ("s", 10), ("s", 11)}


def test_writes_by_offset(spark):
    ops = [op(1, "create", "/f"), op(2, "write", "/f", data="abc", data_length=3, offset=2), op(3, "truncate", "/f", length=4),
           op(4, "create", "/g"), op(5, "write", "/g", data="cut...", data_length=900, offset=0), op(6, "symlink", "f", target="/l"), op(7, "link", "/f", target="/h"),
           op(8, "chown", "/h", uid=5, gid=-1)]
    state, failed = replayed(spark, [entry("")], ops)
    assert state["s", "f"] == (False, 0o644, 4, "\0\0ab") == state["s", "l"] == state["s", "h"]
    assert state["s", "g"] == (False, 0o644, 900, None) and not failed


def random_history(rng, session, n):
    names = ["a", "b", "a/x", "a/y", "b/x", "b/y", "a/x/p", "b/x/p", "fix/u", "fix/v", "fix/u/q", "c"]
    ops = []
    for i in range(n):
        kind = rng.choice(replay.CHANGING_OPS)
        params, path = {}, "/" + rng.choice(names)
        if kind == "rename":
            params["new_path"] = "/" + rng.choice(names)
        if kind in ("link", "symlink"):
            params["target"] = "/" + rng.choice(names)
        if kind == "write":
            data = rng.choice(["", "é", "data"])
            params.update(data=data, data_length=len(data.encode()), offset=rng.choice([0, 0, 3]))
        if kind == "truncate":
            params["length"] = rng.choice([0, 2, 7])
        if kind == "chmod":
            params["mode"] = rng.choice(["0o100600", "0o40700"])
        ops.append(op(i, kind, path, session, **params))
    return ops


def test_scoped_fold_equals_plain_model(spark):
    rng, initial, ops, want, bad = random.Random(5), [], [], {}, set()
    for k in range(40):
        session = f"r{k}"
        start = [entry(p, snap=session) for p in ("", "fix", "a", "a/x")] + [entry("fix/u", False, 0o600, size=3, content="abc", snap=session)]
        history = random_history(rng, session, 40)
        initial += start
        ops += history
        state, failed = model(start, history)
        want.update({(session, p): v for p, v in state.items()})
        bad |= {(session, seq) for seq in failed}
    got, failed = replayed(spark, initial, ops)
    assert failed == bad
    assert got == want


@pytest.mark.parametrize("width", [1, 7, 8192])
def test_file_windows_equal_fold(spark, width):
    """Histories of file operations: ranges of any width give what the fold gives."""
    rng, initial, ops = random.Random(8), [], []
    for k in range(40):
        session = f"w{k}"
        initial += [entry(p, snap=session) for p in ("", "d")] + [entry("d/u", False, 0o600, size=3, content="abc", snap=session), entry("v", False, size=9, snap=session)]
        for i in range(60):
            kind = rng.choice(["create", "write", "truncate", "unlink", "chmod", "chown"])
            params = {"write": {"data_length": rng.choice([2, 5, 30]), "offset": 0, **({"data": "xyzzy"} if rng.random() < 0.5 else {})}, "truncate": {"length": rng.choice([0, 0, 7])},
                      "chmod": {"mode": rng.choice(["0o100600", "0o100755"])}, "chown": {"uid": rng.choice([-1, 3]), "gid": 4}, "create": rng.choice([{}, {"mode": "0o100640"}])}.get(kind, {})
            ops.append(op(i, kind, "/" + rng.choice(["d/u", "d/n", "v", "none/x", "d", "w"]), session, **params))
    start, log = table(spark, initial), spark.createDataFrame(ops, schema.OPS)
    rows, refused = replay.fold_files(start, log, width)
    assert refused.isEmpty()
    plain = replay.fold(start, log, with_before=True)
    assert set(map(str, replay.outcomes(rows).collect())) == set(map(str, replay.outcomes(plain).collect()))
    columns = ["session", "seq", "path", "deleted", "is_dir", "mode", "owner", "group", "mtime", "size", "before"]
    left, right = (f.filter("kind = 'change'").select(*columns, "content").collect() for f in (rows, plain))
    bare = lambda r: (r[:10], r.before and (r.before["mode"], r.before["size"], r.before["mtime"]))
    assert {bare(r) for r in left} == {bare(r) for r in right}
    known = {(r.session, r.seq): r.content for r in right}
    assert all(r.content is None or r.content == known[r.session, r.seq] for r in left)


def test_a_hot_path_is_spread(spark):
    """One path with all operations: sizes add up over the ranges, and many tasks work on it."""
    n = 4000
    log = spark.range(n).selectExpr(
        "'s' AS session", "id + 1 AS seq", "IF(id = 0, 'create', 'write') AS operation", "'/f' AS path", "timestamp_seconds(id) AS ts",
        "IF(id = 0, map('mode', '0o100644'), map('data_length', '5', 'offset', CAST(5 * (id - 1) AS string))) AS parameters",
    )
    rows, _ = replay.fold_files(table(spark, [entry("", snap="s")]), log, 100)
    changes = rows.filter("kind = 'change'")
    assert changes.selectExpr("count(*)", "sum(size)", "max(size)").first() == (n, 5 * (n - 1) * n // 2, 5 * (n - 1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert changes.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_transitions_chain(spark):
    ops = [op(1, "create", "/f"), op(2, "write", "/f", data="abc", data_length=3), op(3, "create", "/g"), op(4, "rename", "/f", new_path="/g")]
    rows = replay.transitions(table(spark, [entry("")]), spark.createDataFrame(ops, schema.OPS)).collect()
    got = {(r.seq, r.path): (r.before and r.before["size"], r.after and r.after["size"]) for r in rows}
    assert got == {(1, "f"): (None, 0), (2, "f"): (0, 3), (3, "g"): (None, 0), (4, "f"): (3, None), (4, "g"): (0, 3)}


def test_examples(spark):
    initial = [entry("", snap=s) for s in "abc"] + [entry("f", False, 0o644, size=5000, content="y" * 5000, snap="b")]
    ops = [op(1, "mkdir", "/d", "a"), op(2, "getattr", "/d", "a"), op(1, "read", "/f", "b", size=10), op(1, "release", "/f", "c")]
    examples = dataset.build_examples(table(spark, initial), spark.createDataFrame(ops, schema.OPS))
    rows = {r.session: r for r in examples.collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].operation == "mkdir('/d')" and 'path="d"' in rows["a"].result and 'path="d"' not in rows["a"].initial_state
    assert rows["b"].result == "y" * 5000 and "y" * 5000 in rows["b"].initial_state
    pair = {r.example_id: r for r in dataset.to_pairs(examples).collect()}["a"]
    assert pair.prompt.startswith("<W>\nmkdir('/d')\n---\n<filesystem>") and pair.completion.endswith("</filesystem>\n<END_FS>")
    assert dataset.build_examples(table(spark, initial), spark.createDataFrame(ops, schema.OPS), max_tokens=100).collect()[0].session == "a"


def test_synthetic_operations_replay(spark):
    start = [entry(p, snap=f"s{i}") for i in range(60) for p in ("", "dir1", "dir1/subdir")]
    start += [entry(p, False, 0o644, size=20, content="x" * 20, snap=f"s{i}") for i in range(60) for p in ("file1.txt", "dir1/file2.txt")]
    df = table(spark, start)
    for make in (synth.random_ops, synth.targeted_ops):
        ops = make(df, "3").withColumn("ts", F.lit(0).cast("timestamp")).select("session", "seq", "operation", "path", "ts", "parameters").cache()
        assert ops.select("session").distinct().count() > 50
        # A directory may clash with an existing name; nothing else may fail.
        wrong = replay.outcomes(replay.fold(df, ops)).filter("NOT ok").collect()
        assert all(r.operation == "mkdir" for r in wrong), wrong
    covered = synth.ensure_coverage(df.filter("is_dir AND path = ''"), "3", min_files=2)
    assert snapshot.coverage(covered, 2).filter("NOT covered").isEmpty()


def test_strict_guard(spark):
    pairs = spark.createDataFrame([("1", "p", "text... (9 more)")], schema.PAIRS)
    with pytest.raises(Exception, match="truncation mark"):
        dataset.assert_untruncated(pairs).collect()
