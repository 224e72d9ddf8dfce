"""Synthetic operations: weighted kinds, operands picked from snapshots, generated names.

All rows are trace rows (session, seq, operation, path, parameters) that replay accepts; a
fall-back that needs two operations gives two rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optrace import constants as K
from optrace.functions import paths
from optrace.functions.names import with_content, with_dirname, with_filename
from optrace.functions.sampling import choose, hash60, integer, uniform, weighted
from optrace.operators.snapshot import candidates, coverage
from optrace.schema import ENTRY_COLUMNS


def _params(**values) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    pairs = []
    for key, value in values.items():
        pairs += [F.lit(key), (F.lit(value) if isinstance(value, str) else value).cast("string")]
    return F.create_map(*pairs)


def _op(name: str, path: Column, **params) -> Column:
    return F.struct(
        F.lit(name).alias("operation"), path.alias("path"), _params(**params).alias("parameters")
    )


def _rows(*ops: Column) -> Column:
    return F.array(*ops)


def _write(path: Column, content: Column) -> list[Column]:
    return [
        _op("create", path, mode="0o100644"),
        _op("write", path, data=content, data_length=F.octet_length(content), offset="0"),
    ]


def _mkdir_chain(path: Column) -> Column:
    """mkdir of a path and of every directory above it."""
    return F.transform(paths.ancestors(path), lambda p: _op("mkdir", p, mode="0o755"))


def sample_ops(ids: DataFrame, id_column: str, seed: str, weights: dict | None = None) -> DataFrame:
    """Adds shell_op, one of the weighted kinds."""
    return ids.withColumn("shell_op", weighted(weights or K.OP_WEIGHTS, F.lit(seed), F.col(id_column)))


def scenario_mix(ids: DataFrame, id_column: str, seed: str, targeted_share: float = K.TARGETED_SHARE) -> DataFrame:
    """Adds mode: 'sparse', else 'targeted' with the given share (clamped to 0..1), else 'random'."""
    share = max(0.0, min(1.0, targeted_share))
    sparse = uniform(F.lit(seed), F.lit("sparse"), F.col(id_column)) < K.SPARSE_SHARE
    targeted = uniform(F.lit(seed), F.lit("targeted"), F.col(id_column)) < share
    return ids.withColumn("mode", F.when(sparse, "sparse").when(targeted, "targeted").otherwise("random"))


def _with_operands(df: DataFrame, seed: str, key: str) -> DataFrame:
    """Adds what any operation of a row may draw on: a file name, directory names, a chain of
    them, and numbers."""
    k, s = F.col(key), F.lit(seed)
    df = with_filename(df, "_file", s, F.lit("file"), k)
    for i in range(5):
        df = with_dirname(df, f"_dir{i}", s, F.lit(f"dir{i}"), k)
    return df.withColumns({
        "_nested": uniform(s, F.lit("nested"), k) < 0.3,
        "_depth": integer(2, 5, s, F.lit("depth"), k).cast("int"),
        "_below": uniform(s, F.lit("below"), k) < 0.3,
        "_length": integer(0, 100, s, F.lit("length"), k),
        "_chmod": F.concat(F.lit("0o100"), choose(K.CHMOD_MODES, s, F.lit("mode"), k)),
    })


def _chain(count: Column) -> Column:
    return F.array_join(F.slice(F.array(*[F.col(f"_dir{i}") for i in range(5)]), F.lit(1), count), "/")


def _on_file() -> Column:
    return F.col("any").isNotNull() & F.col("any_is_file")


def _random_rows(kind: Column) -> Column:
    """Operations of one shell-level kind; fall-backs where the state offers no operand.
    Writes go to _content_path with the content made for it."""
    any_path, file, folder = F.col("any"), F.col("_file"), F.col("_dir0")
    has_any, on_file = any_path.isNotNull(), _on_file()
    on_dir = has_any & ~F.col("any_is_file")
    mkdir, create = _mkdir_chain(folder), _rows(_op("create", file, mode="0o100644"))
    owner = {"uid": "1000", "gid": "1000"}
    new_path = F.concat(F.lit("/"), F.when(F.col("any_is_file"), file).otherwise(folder))
    link = F.concat(F.lit("/link_to_"), file)
    return (
        F.when(kind == "mkdir", F.when(F.col("_nested"), _mkdir_chain(_chain(F.col("_depth")))).otherwise(mkdir))
        .when(kind == "touch", F.when(
            on_dir & F.col("_below"), _rows(_op("create", paths.join(any_path, file), mode="0o100644"))
        ).otherwise(create))
        .when(kind == "rm", F.when(on_file, _rows(_op("unlink", any_path))).otherwise(
            F.concat(create, _rows(_op("unlink", file)))))
        .when(kind == "rmdir", F.when(on_dir & F.col("any_is_empty"), _rows(_op("rmdir", any_path))).otherwise(
            _rows(_op("mkdir", folder, mode="0o755"), _op("rmdir", folder))))
        .when(kind == "chmod", F.when(has_any, _rows(_op("chmod", any_path, mode=F.col("_chmod")))).otherwise(
            F.concat(create, _rows(_op("chmod", file, mode="0o100644")))))
        .when(kind == "chown", F.when(has_any, _rows(_op("chown", any_path, **owner))).otherwise(
            F.concat(create, _rows(_op("chown", file, **owner)))))
        .when(kind == "truncate", F.when(on_file, _rows(_op("truncate", any_path, length=F.col("_length")))).otherwise(mkdir))
        .when(kind == "rename", F.when(has_any, _rows(_op("rename", any_path, new_path=new_path))).otherwise(create))
        # The referent of a link is read from the link's directory, here the root.
        .when(kind == "symlink", F.when(has_any, _rows(_op("symlink", any_path, target=link))).otherwise(mkdir))
        .when(kind == "ls", _rows(_op("readdir", F.coalesce(F.col("parent_dir"), F.lit("")))))
        .when(kind == "stat", _rows(_op("getattr", F.coalesce(any_path, F.lit("")))))
        .when(kind == "write", F.array(*_write(F.col("_content_path"), F.col("_content"))))
        # No readable file: no operation at all.
        .when((kind == "read") & F.col("file").isNotNull(), _rows(_op("read", F.col("file"))))
    )


def _with_picks(entries: DataFrame, seed: str) -> DataFrame:
    """One row per snapshot with a candidate of every kind. All entries are looked up in, so they are
    merged, never broadcast, as in candidates."""
    picked = candidates(entries, seed)
    kinds = entries.select("snapshot_id", F.col("path").alias("any"), (~F.col("is_dir")).alias("any_is_file"), F.col("size").alias("any_size"))
    sizes = entries.select("snapshot_id", F.col("path").alias("file16"), F.col("size").alias("file16_size"))
    children = entries.select("snapshot_id", paths.parent(F.col("path")).alias("any")).distinct().withColumn("_child", F.lit(True))
    return (
        picked.join(kinds.hint("merge"), ["snapshot_id", "any"], "left")
        .join(children.hint("merge"), ["snapshot_id", "any"], "left")
        .join(sizes.hint("merge"), ["snapshot_id", "file16"], "left")
        .withColumn("any_is_file", F.coalesce("any_is_file", F.lit(False)))
        .withColumn("any_is_empty", F.col("_child").isNull()).drop("_child")
    )


def _emit(df: DataFrame, session: Column, first_seq: Column, rows: str = "_rows") -> DataFrame:
    """Operation arrays as trace rows; NULL arrays give none."""
    # The outer form: the plain one makes the planner test the array's size, and so build
    # every array twice.
    out = df.select(
        session.cast("string").alias("session"), first_seq.alias("_first"), F.posexplode_outer(rows).alias("_pos", "_op")
    )
    return out.filter("_pos IS NOT NULL").select(
        "session", (F.col("_first") + F.col("_pos")).cast("bigint").alias("seq"), "_op.operation",
        F.concat(F.lit("/"), F.col("_op.path")).alias("path"), "_op.parameters",
    )


def random_ops(entries: DataFrame, seed: str) -> DataFrame:
    """One random operation per snapshot."""
    state = _with_operands(sample_ops(_with_picks(entries, seed), "snapshot_id", seed), seed, "snapshot_id")
    state = state.withColumn("_content_path", F.when(_on_file(), F.col("any")).otherwise(F.col("_file")))
    state = with_content(state, "_content_path", "_content")
    return _emit(state.withColumn("_rows", _random_rows(F.col("shell_op"))), F.col("snapshot_id"), F.lit(0))


def targeted_ops(entries: DataFrame, seed: str) -> DataFrame:
    """One operation per snapshot from the edge-case scenarios; a scenario without a
    candidate falls back to a random operation."""
    key, s = F.col("snapshot_id"), F.lit(seed)
    state = _with_operands(sample_ops(_with_picks(entries, seed), "snapshot_id", seed), seed, "snapshot_id")
    scenario, file, file16 = F.col("_scenario"), F.col("file"), F.col("file16")
    state = state.withColumn("_scenario", choose(K.TARGETED_SCENARIOS, s, F.lit("scenario"), key))
    overwrite = (scenario == "overwrite_existing") & file.isNotNull()
    made = scenario.isin("write_then_read", "write_text_log")
    state = (
        state.withColumn("_content_path", F.when(made, F.col("_file")).when(_on_file(), F.col("any")).otherwise(F.col("_file")))
        .withColumn("_seed_path", F.when(overwrite, F.concat(file, F.lit(":overwrite"))).otherwise(F.col("_content_path")))
        .withColumn("_new_size", F.pmod(integer(0, 2**40, s, F.lit("new size"), key), F.greatest("file16_size", F.lit(2))))
    )
    state = with_content(state, "_seed_path", "_content")
    content, new_file = F.col("_content"), F.col("_file")
    link = F.concat(F.lit("/"), file, F.lit("_link"))
    # The referent is named from the root, so it is absolute in a log.
    rows = (
        F.when(scenario == "nested_mkdir", _mkdir_chain(_chain(F.lit(3))))
        .when((scenario == "truncate_existing") & file16.isNotNull(), _rows(_op("truncate", file16, length=F.col("_new_size"))))
        .when(overwrite, F.array(*_write(file, content)))
        .when((scenario == "unlink_existing") & file.isNotNull(), _rows(_op("unlink", file)))
        .when((scenario == "rmdir_empty") & F.col("empty_dir").isNotNull(), _rows(_op("rmdir", F.col("empty_dir"))))
        .when((scenario == "symlink_existing") & file.isNotNull(), _rows(_op("symlink", file, target=link)))
        .when(scenario == "write_text_log", F.array(*_write(new_file, F.lit(K.LOG_TEXT))))
        .when(scenario == "write_then_read", F.array(*_write(new_file, content), _op("read", new_file)))
        .otherwise(_random_rows(F.col("shell_op")))
    )
    return _emit(state.withColumn("_rows", rows), key, F.lit(0))


def sparse_ops(ids: DataFrame, id_column: str, seed: str) -> DataFrame:
    """One operation per id that works on an empty tree."""
    key, s = F.col(id_column), F.lit(seed)
    named = with_dirname(with_filename(ids.select(id_column), "_file", s, F.lit("file"), key), "_dir", s, F.lit("dir"), key)
    named = with_content(named, "_file", "_content").withColumns({
        "_choice": choose(K.SPARSE_OPS, s, F.lit("sparse"), key), "_size": integer(0, 64, s, F.lit("size"), key),
    })
    kind, file = F.col("_choice"), F.col("_file")
    create = _op("create", file, mode="0o100644")
    rows = (
        F.when(kind == "mkdir", _mkdir_chain(F.col("_dir")))
        .when(kind == "create", _rows(create))
        .when(kind == "write", F.array(*_write(file, F.col("_content"))))
        .when(kind == "truncate", _rows(create, _op("truncate", file, length=F.col("_size"))))
        .otherwise(_rows(_op("readdir", F.lit(""))))
    )
    return _emit(named.withColumn("_rows", rows), key, F.lit(0))


MADE = "array<struct<path: string, is_dir: boolean>>"


def _after(made: Column, row: Column) -> Column:
    """The entries (path, is_dir) there are after an operation on them; links are not kept."""
    path, op = row["path"], row["operation"]
    target = F.ltrim(F.coalesce(row["parameters"]["new_path"], F.lit("")), F.lit("/"))
    without = lambda gone: F.filter(made, lambda x: x["path"] != gone)
    add = F.when(F.exists(made, lambda x: x["path"] == path), made).otherwise(
        F.concat(made, F.array(F.struct(path.alias("path"), (op == "mkdir").alias("is_dir")).cast("struct<path: string, is_dir: boolean>")))
    )

    def moved(x: Column) -> Column:
        below = F.startswith(x["path"], F.concat(path, F.lit("/")))
        new = F.when(x["path"] == path, target).when(below, F.concat(target, F.substring(x["path"], F.char_length(path) + 1, F.lit(2**31 - 1)))).otherwise(x["path"])
        return F.struct(new.alias("path"), x["is_dir"].alias("is_dir"))

    renamed = F.when(path == target, made).otherwise(F.transform(without(target), moved))
    return (
        F.when(op.isin("create", "mkdir"), add).when(op.isin("unlink", "rmdir"), without(path)).when(op == "rename", renamed).otherwise(made).cast(MADE)
    )


def _picks_of_made(df: DataFrame, seed: str, key: str) -> DataFrame:
    """A candidate of every kind from the entries in _made, as _with_picks has them for a snapshot."""
    k, s, made = F.col(key), F.lit(seed), F.col("_made")

    def pick(of: Column, kind: str) -> Column:
        return F.get(of, F.pmod(hash60(s, F.lit(kind), k), F.greatest(F.size(of), F.lit(1)).cast("bigint")).cast("int"))

    inside = lambda folder: F.exists(made, lambda x: F.startswith(x["path"], F.concat(folder, F.lit("/"))))
    df = df.withColumns({
        "_any": pick(made, "made"), "_file_of": pick(F.filter(made, lambda x: ~x["is_dir"]), "made file"),
        "_parent_of": pick(F.filter(made, lambda x: x["is_dir"] & inside(x["path"])), "made parent"),
    })
    return df.withColumns({
        "any": F.col("_any.path"), "any_is_file": F.coalesce(~F.col("_any.is_dir"), F.lit(False)), "file": F.col("_file_of.path"),
        "parent_dir": F.col("_parent_of.path"), "any_is_empty": F.coalesce(~inside(F.col("_any.path")), F.lit(True)),
    }).drop("_any", "_file_of", "_parent_of")


def setup_ops(ids: DataFrame, id_column: str, seed: str) -> DataFrame:
    """History before the example: none to three operations, then with even odds one more file. A
    session starts empty, and each operation draws its operands from what those before it have made:
    the entries are carried from round to round as an array of a few rows per session."""
    s, key = F.lit(seed), F.col(id_column).cast("string")
    rounds = max(K.SETUP_COUNT_WEIGHTS)
    state = ids.select(id_column).withColumn("_count", weighted(K.SETUP_COUNT_WEIGHTS, s, F.lit("setup count"), key))
    state = state.withColumn("_made", F.array().cast(MADE))
    operands = None
    for step in range(1, rounds + 1):
        state = state.withColumn("_key", F.concat_ws("#", key, F.lit(step)))
        state = _with_operands(_picks_of_made(sample_ops(state, "_key", seed), seed, "_key"), seed, "_key")
        state = state.withColumn("_content_path", F.when(_on_file(), F.col("any")).otherwise(F.col("_file")))
        state = with_content(state, "_content_path", "_content")
        state = state.withColumn(f"_rows{step}", F.when(F.col("_count") >= step, _random_rows(F.col("shell_op"))))
        made = F.aggregate(F.coalesce(f"_rows{step}", F.array().cast(state.schema[f"_rows{step}"].dataType)), F.col("_made"), _after)
        state = state.withColumn("_made", made)
        operands = operands or [c for c in state.columns if c not in (id_column, "_count", "_made", f"_rows{step}")]
        state = state.drop(*operands)
    history = None
    for step in range(1, rounds + 1):
        rows = _emit(state, F.col(id_column), F.lit(step * 10), f"_rows{step}")
        history = rows if history is None else history.unionByName(rows)
    extra = ids.select(id_column).filter(uniform(s, F.lit("extra file"), key) < K.EXTRA_FILE_SHARE)
    extra = with_content(with_filename(extra, "_file", s, F.lit("extra"), key), "_file", "_content")
    file = _emit(extra.withColumn("_rows", F.array(*_write(F.col("_file"), F.col("_content")))), F.col(id_column), F.lit(100))
    return history.unionByName(file)


def ensure_coverage(entries: DataFrame, seed: str, min_files: int = 1, min_children: int = 2) -> DataFrame:
    """Entries plus what a snapshot lacks: min_files regular files, an empty directory, a
    directory with children. Added names start with 'cover_', which no generated name does."""
    key, s, n = F.col("snapshot_id"), F.lit(seed), F.col("n")
    lacking = coverage(entries, min_files).filter("NOT covered")
    lacking = with_dirname(lacking, "_empty", s, F.lit("empty"), key)
    lacking = with_dirname(lacking, "_full", s, F.lit("full"), key)
    folder = F.concat(F.lit("cover_full_"), F.col("_full"))
    dirs = lacking.select(
        "snapshot_id",
        F.explode(F.filter(F.array(
            F.when(~F.col("has_empty_dir"), F.concat(F.lit("cover_empty_"), F.col("_empty"))),
            F.when(~F.col("has_populated_dir"), folder),
        ), lambda p: p.isNotNull())).alias("path"),
    ).select("snapshot_id", "path", F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("content"))

    top = lacking.filter(F.col("n_files") < min_files).select(
        "snapshot_id", F.lit("").alias("folder"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(min_files) - F.col("n_files"))).alias("n")
    )
    children = lacking.filter(~F.col("has_populated_dir")).select(
        "snapshot_id", folder.alias("folder"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(max(1, min_children)).cast("bigint"))).alias("n")
    )
    files = with_filename(top.unionByName(children), "_file", s, key, F.col("folder"), n)
    files = files.withColumn("path", paths.join(F.col("folder"), F.concat(F.lit("cover_"), n.cast("string"), F.lit("_"), F.col("_file"))))
    files = with_content(files, "path", "content").select("snapshot_id", "path", F.lit(False).alias("is_dir"), "content")
    added = dirs.unionByName(files).select(
        "snapshot_id", "path", paths.name(F.col("path")).alias("name"), "is_dir",
        F.when(F.col("is_dir"), 0o755).otherwise(0o644).alias("mode"), F.lit("root").alias("owner"), F.lit("root").alias("group"),
        F.lit(0.0).alias("mtime"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("size"), "content",
    )
    return entries.select(ENTRY_COLUMNS).unionByName(added)
