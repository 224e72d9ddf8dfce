"""Replay of operation logs into file-tree state.

Order matters only among operations that can see each other's effect. A directory that
exists at the start and that no operation creates, removes, moves or replaces (nor any
directory above it) is fixed for the whole session, so the trees below it are independent.
replay therefore cuts each session into scopes at its fixed directories, joins scopes that
a rename or link connects, and folds every (session, scope) on its own, in log order and
streaming. A session with a third of all operations spreads over its scopes."""

from collections.abc import Iterator, Sequence
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optrace.functions import paths, text
from optrace.operators import transition
from optrace.schema import ATTRIBUTES
from optrace.session import cut_lineage

CHANGING_OPS = [
    "mkdir", "create", "write", "truncate", "unlink", "rmdir", "rename", "chmod", "chown", "link", "symlink",
]
MAKING_OPS = ["mkdir", "create", "unlink", "rmdir", "rename"]
LINKING_OPS = ["link", "symlink"]
TREE_OPS = ["mkdir", "rmdir", "rename", "link", "symlink"]

STATE = "is_dir boolean, mode int, owner string, `group` string, mtime double, size bigint, content string"
STATE_COLUMNS = ["is_dir", "mode", "owner", "group", "mtime", "size", "content"]
FOLD_COLUMNS = f"""session string, seq bigint, operation string, kind string, step int, path string,
    reason string, errno string, deleted boolean, {STATE}, before struct<{STATE.replace(" ", ":").replace(",:", ", ")}>"""


def prepared_ops(ops: DataFrame) -> DataFrame:
    """State-changing operations with snapshot paths and typed parameters. Links name their
    source in path and the new entry in new_path."""
    param, op, new_path = F.col("parameters"), F.col("operation"), F.col("new_path")
    target = F.when(op == "rename", param["new_path"]).when(op.isin(LINKING_OPS), param["target"])
    changing = (
        ops.withColumn("operation", F.lower("operation")).filter(op.isin(CHANGING_OPS))
        .withColumn("new_path", F.regexp_replace(target, "^/+|/+$", ""))
        .withColumn("_above", F.when(op == "symlink", F.coalesce(paths.parent(new_path), F.lit(""))))
    )
    path = F.when(op == "symlink", paths.resolve(F.col("_above"), F.col("path"))).otherwise(paths.normalize(F.col("path")))
    needs_new = op.isin("rename", *LINKING_OPS)
    return changing.filter(~needs_new | new_path.isNotNull()).select(
        "session", "seq", "operation", path.alias("path"), "new_path",
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("mtime"),
        text.octal_to_mode(param["mode"]).alias("mode"),
        param["offset"].cast("bigint").alias("offset"),
        param["length"].cast("bigint").alias("length"),
        param["data_length"].cast("bigint").alias("data_length"),
        param["data"].alias("data"), param["uid"].alias("uid"), param["gid"].alias("gid"),
    )


def _initial_state(initial: DataFrame) -> DataFrame:
    return initial.withColumnRenamed("snapshot_id", "session").select("session", "path", *STATE_COLUMNS)


def _fixed_depths(initial: DataFrame, ops: DataFrame) -> DataFrame:
    """(session, parent, fixed): how many leading names of a directory path are fixed
    directories, for every parent of an entry or an operation's path."""
    structural = (
        ops.filter(F.col("operation").isin(MAKING_OPS)).select("session", "path")
        .union(ops.filter(F.col("new_path").isNotNull()).select("session", "new_path"))
        .distinct()
    )
    dirs = initial.filter("is_dir AND path <> ''").select("session", "path")
    loose = (
        dirs.select("session", F.col("path").alias("dir"), F.explode(paths.ancestors(F.col("path"))).alias("path"))
        .join(structural, ["session", "path"], "left_semi")
        .select("session", F.col("dir").alias("path")).distinct()
    )
    fixed = dirs.join(loose, ["session", "path"], "left_anti").select(
        "session", F.col("path").alias("above"), F.lit(True).alias("_fixed")
    )
    parent = paths.parent(F.col("path"))
    used = (
        initial.select("session", parent.alias("parent"))
        .union(ops.select("session", parent))
        .union(ops.filter(F.col("new_path").isNotNull()).select("session", paths.parent(F.col("new_path"))))
        .filter(F.col("parent").isNotNull()).distinct()
    )
    levels = used.select(
        "session", "parent", F.posexplode_outer(paths.ancestors(F.col("parent"))).alias("level", "above")
    )
    return (
        levels.join(fixed, ["session", "above"], "left").groupBy("session", "parent")
        .agg(F.coalesce(F.max(F.when(F.col("_fixed"), F.col("level") + 1)), F.lit(0)).alias("fixed"))
    )


def _scoped(df: DataFrame, depths: DataFrame, column: str, prefix: str) -> DataFrame:
    """Adds <prefix>scope, the first part of the path that is not fixed, and <prefix>parent_fixed."""
    path = F.col(column)
    keyed = df.withColumn("parent", F.coalesce(paths.parent(path), F.lit("")))
    return (
        keyed.join(depths, ["session", "parent"], "left")
        .withColumn(f"{prefix}scope", paths.prefix(path, F.col("fixed") + 1))
        .withColumn(f"{prefix}parent_fixed", F.col("fixed") == paths.depth(F.col("parent")))
        .drop("parent", "fixed")
    )


def connected(edges: DataFrame) -> DataFrame:
    """(session, scope, component) for the scopes of edges(session, a, b): the least scope
    reachable. Labels travel along edges and are shortened each round."""
    both = cut_lineage(edges.union(edges.select("session", "b", "a")).distinct())
    labels = both.groupBy("session", F.col("a").alias("scope")).agg(F.min(F.least("a", "b")).alias("component"))
    while True:
        labels = cut_lineage(labels)
        near = (
            both.join(labels.withColumnRenamed("scope", "b"), ["session", "b"])
            .groupBy("session", F.col("a").alias("scope")).agg(F.min("component").alias("near"))
        )
        stepped = labels.join(near, ["session", "scope"]).select(
            "session", "scope", F.col("component").alias("old"), F.least("component", "near").alias("hop")
        )
        shorter = labels.select("session", F.col("scope").alias("hop"), F.col("component").alias("jump"))
        moved = cut_lineage(
            stepped.join(shorter, ["session", "hop"]).select(
                "session", "scope", "old", F.least("hop", "jump").alias("component")
            )
        )
        labels = moved.drop("old")
        if moved.filter("old <> component").isEmpty():
            return labels


def fold_input(initial: DataFrame, ops: DataFrame) -> DataFrame:
    """Rows of the fold: entries (operation NULL, seq -1) and operations, with the component
    that must see them together."""
    state, changing = _initial_state(initial), prepared_ops(ops)
    depths = _fixed_depths(state, changing)
    single = _scoped(changing.filter("new_path IS NULL"), depths, "path", "").select(
        "*", F.lit(None).cast("string").alias("new_scope"), F.lit(None).cast("boolean").alias("new_parent_fixed")
    )
    double = _scoped(
        _scoped(changing.filter("new_path IS NOT NULL"), depths, "path", ""), depths, "new_path", "new_"
    )
    scoped_ops = single.unionByName(double)
    scoped_state = _scoped(state, depths, "path", "")
    edges = double.filter("scope <> new_scope").select(
        "session", F.col("scope").alias("a"), F.col("new_scope").alias("b")
    )
    if edges.isEmpty():
        scoped_ops = scoped_ops.withColumnRenamed("scope", "component")
        scoped_state = scoped_state.withColumnRenamed("scope", "component")
    else:
        labels = connected(edges)

        def labelled(df: DataFrame) -> DataFrame:
            joined = df.join(labels, ["session", "scope"], "left")
            return joined.withColumn("component", F.coalesce("component", "scope")).drop("scope")

        scoped_ops, scoped_state = labelled(scoped_ops), labelled(scoped_state)
    # State nothing happens to stays out of the fold.
    touched = scoped_ops.select("session", "component").distinct()
    scoped_state = scoped_state.join(touched, ["session", "component"], "left_semi")
    return scoped_ops.drop("new_scope").unionByName(
        scoped_state.withColumn("seq", F.lit(-1).cast("bigint")), allowMissingColumns=True
    )


_ARROW_STATE = [
    ("is_dir", pa.bool_()), ("mode", pa.int32()), ("owner", pa.string()), ("group", pa.string()),
    ("mtime", pa.float64()), ("size", pa.int64()), ("content", pa.string()),
]
_ARROW_FOLD = pa.schema([
    ("session", pa.string()), ("seq", pa.int64()), ("operation", pa.string()), ("kind", pa.string()),
    ("step", pa.int32()), ("path", pa.string()), ("reason", pa.string()), ("errno", pa.string()),
    ("deleted", pa.bool_()), *_ARROW_STATE, ("before", pa.struct(_ARROW_STATE)),
])


def _fold_partition(with_before: bool):
    """Runs a partition sorted by group and log order as one stream. A new group starts a new
    state, so no more than one group's own state is held, and no group costs a call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, store, last = None, None, -1
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["session"], row["component"]) != group:
                    group, store, last = (row["session"], row["component"]), transition.DictStore(), -1
                if row["seq"] < last:
                    raise RuntimeError("operations of one group arrived out of order")
                last = row["seq"]
                if row["operation"] is None:
                    store.put(row["path"], [row[c] for c in STATE_COLUMNS])
                else:
                    out.extend(_step(store, row, with_before))
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW_FOLD)

    return run


def _step(store: transition.DictStore, row: dict, with_before: bool) -> list[dict]:
    """Output rows of one operation."""
    common = {c: row[c] for c in ("session", "seq", "operation")}
    outcome = {**common, "kind": "outcome", "step": 0, "path": row["path"]}
    try:
        touched = transition.apply(store, SimpleNamespace(**row), row["parent_fixed"], row["new_parent_fixed"])
    except transition.Rejected as rejected:
        reason = str(rejected)
        return [{**outcome, "reason": reason, "errno": transition.errno_of(row["operation"], reason)}]
    out = [outcome]
    for step, (path, old, new) in enumerate(touched):
        change = {**common, "kind": "change", "step": step, "path": path, "deleted": new is None}
        if new is not None:
            change.update(zip(STATE_COLUMNS, new))
        if with_before and old is not None:
            change["before"] = dict(zip(STATE_COLUMNS, old))
        out.append(change)
    return out


def fold(initial: DataFrame, ops: DataFrame, with_before: bool = False) -> DataFrame:
    """One row per operation (kind 'outcome') and per entry it touched (kind 'change')."""
    rows = fold_input(initial, ops)
    ordered = rows.repartition("session", "component").sortWithinPartitions("session", "component", "seq")
    return ordered.mapInArrow(_fold_partition(with_before), schema=FOLD_COLUMNS)


def outcomes(folded: DataFrame) -> DataFrame:
    """(session, seq, operation, path, ok, reason, errno): failed operations left the state unchanged."""
    return folded.filter("kind = 'outcome'").select(
        "session", "seq", "operation", "path", F.col("reason").isNull().alias("ok"), "reason", "errno"
    )


def changes(folded: DataFrame) -> DataFrame:
    """(session, seq, step, path, deleted, attributes): the state after every step, as a log."""
    return folded.filter("kind = 'change'").select(
        "session", "seq", "step", "path", "deleted", *STATE_COLUMNS
    )


def _as_entries(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("session").alias("snapshot_id"), "path", paths.name(F.col("path")).alias("name"),
        *[c for c in ATTRIBUTES if c != "name"],
    )


def _versions(initial: DataFrame, change_log: DataFrame) -> DataFrame:
    start = _initial_state(initial).select(
        "session", F.lit(-1).cast("bigint").alias("seq"), F.lit(0).alias("step"), "path",
        F.lit(False).alias("deleted"), *STATE_COLUMNS,
    )
    return start.unionByName(change_log)


def replay(initial: DataFrame, ops: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Entries after the last operation of every session; rows of fold or folded, if at hand."""
    log = changes(rows if rows is not None else folded(initial, ops))
    state = F.struct("deleted", *STATE_COLUMNS)
    latest = _versions(initial, log).groupBy("session", "path").agg(
        F.max_by(state, F.struct("seq", "step")).alias("state")
    )
    return _as_entries(latest.select("session", "path", "state.*").filter(~F.col("deleted")))


def state_around(initial: DataFrame, change_log: DataFrame, steps: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """State just before and just after chosen steps(session, seq), one step per session:
    entries with column side = 'before' or 'after', and the columns of steps to keep."""
    wanted = steps.select("session", F.col("seq").alias("at"), *keep)
    order = F.struct("seq", "step")
    state = F.struct("deleted", *STATE_COLUMNS)
    picked = (
        _versions(initial, change_log).join(wanted, "session").filter(F.col("seq") <= F.col("at"))
        .groupBy("session", "path", *keep)
        .agg(
            F.max_by(F.when(F.col("seq") < F.col("at"), state), F.when(F.col("seq") < F.col("at"), order)).alias("before"),
            F.max_by(state, order).alias("after"),
        )
    )
    sides = F.array(
        F.struct(F.lit("before").alias("side"), F.col("before").alias("state")),
        F.struct(F.lit("after").alias("side"), F.col("after").alias("state")),
    )
    rows = picked.select("session", "path", *keep, F.inline(sides)).filter("state IS NOT NULL AND NOT state.deleted")
    entries = rows.select("session", "path", "side", *keep, "state.*")
    return entries.select(
        F.col("session").alias("snapshot_id"), "side", "path", paths.name(F.col("path")).alias("name"),
        *[c for c in ATTRIBUTES if c != "name"], *keep,
    )


def transitions(initial: DataFrame, ops: DataFrame) -> DataFrame:
    """Per operation and touched path the entry before and after it, as structs:
    (session, seq, operation, path, before, after). Untouched paths are equal on both sides
    and are not repeated."""
    log = folded(initial, ops).filter("kind = 'change'")
    after = F.when(~F.col("deleted"), F.struct(*STATE_COLUMNS))
    # An operation may touch a path twice (a rename onto an existing file).
    return log.groupBy("session", "seq", "operation", "path").agg(
        F.min_by("before", "step").alias("before"), F.max_by(after, "step").alias("after")
    )


#: Operations of one path that are taken as they are; a path with more is cut in ranges of so many log numbers.
RANGE = 8192


def plain_sessions(ops: DataFrame, width: int = RANGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operations of sessions that only touch files, sessions that need fold(), paths with more than width
    operations): the second have directory, rename or link operations, or writes whose bytes the log holds
    in part of a file. One pass over the log finds both lists."""
    changing = prepared_ops(ops)
    whole = F.coalesce("offset", F.lit(0)) == 0
    needs_fold = F.col("operation").isin(TREE_OPS) | ((F.col("operation") == "write") & F.col("data").isNotNull() & ~whole)
    facts = changing.groupBy("session", "path").agg(F.count(F.lit(1)).alias("n"), F.bool_or(needs_fold).alias("fold"))
    facts = cut_lineage(facts.filter(F.col("fold") | (F.col("n") > width)))
    refused = facts.filter("fold").select("session").distinct()
    if not refused.isEmpty():
        changing = changing.join(refused, "session", "left_anti")
    return changing, refused, facts.filter(F.col("n") > width).select("session", "path")


def _last(value: Column, order: str = "seq") -> Column:
    """The last value of a group that is not NULL."""
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


def fold_files(initial: DataFrame, ops: DataFrame, width: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """fold() by window functions, for sessions that only touch files: (rows as fold gives them,
    sessions left to fold()). What an operation meets depends on its own path alone.

    Paths of at most width operations are worked off whole, after one exchange. The log of a longer one is a
    segmented scan: the operations of every range of width log numbers are summed up in one narrow row (what
    is left after them, or nothing where they leave a value alone), these rows are scanned path by path, and
    each range starts from what the ranges before it left. So a path with any share of the log is spread
    over as many tasks as it has ranges."""
    changing, refused, long = plain_sessions(ops, width)
    changing = changing.filter("session IS NOT NULL AND path IS NOT NULL AND seq IS NOT NULL")
    state = _initial_state(initial)
    if not refused.isEmpty():
        state = state.join(refused, "session", "left_anti")
    dirs = state.filter("is_dir").select("session", F.col("path").alias("_parent"), F.lit(True).alias("_has_parent"))
    rows = changing.withColumn("_parent", F.coalesce(paths.parent(F.col("path")), F.lit("")))
    rows = rows.join(dirs, ["session", "_parent"], "left").withColumn("_makes", F.coalesce("_has_parent", F.col("_parent") == "")).drop("_parent", "_has_parent")
    rows = rows.join(state.select("session", "path", F.struct(*STATE_COLUMNS).alias("start")), ["session", "path"], "left")
    keys, ranged = ["session", "path"], not long.isEmpty()
    if ranged:
        keys = [*keys, "_range"]
        rows = rows.join(long.withColumn("_long", F.lit(True)), ["session", "path"], "left")
        rows = rows.withColumn("_range", F.when(F.col("_long"), F.floor(F.col("seq") / width)).otherwise(-1)).drop("_long")
    rows = rows.withColumn("_dir", F.coalesce("start.is_dir", F.lit(False)))

    op, own, begun = F.col("operation"), Window.partitionBy(*keys).orderBy("seq"), F.col("start").isNotNull()
    before, so_far = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    ranges = Window.partitionBy("session", "path").orderBy("_range")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)

    # Whether the path is there: the last operation that makes or removes it says so.
    lives = F.when((op == "create") & F.col("_makes"), True).when(op == "unlink", False)
    if ranged:
        lived = rows.groupBy(*keys).agg(_last(lives).alias("_lives"))
        lived = lived.select(*keys, F.last("_lives", ignorenulls=True).over(earlier).alias("_lives"))
        rows = rows.join(lived, keys).withColumn("_there_in", F.col("_dir") | F.coalesce("_lives", begun)).drop("_lives")
    else:
        rows = rows.withColumn("_there_in", F.col("_dir") | begun)
    rows = rows.withColumn("_there", F.col("_dir") | F.coalesce(F.last(lives, ignorenulls=True).over(before), F.col("_there_in")))
    is_create, is_attribute = op == "create", op.isin("chmod", "chown")
    reason = (
        F.when(F.col("_dir") & ~is_attribute, "is_directory")
        .when(is_create & ~F.col("_makes"), "parent_missing")
        .when(~is_create & ~F.col("_there"), "missing")
    )
    rows = rows.withColumn("reason", reason)
    done = F.col("reason").isNull()
    new = done & is_create & ~F.col("_there")

    def assigned(at_birth: Column, *cases: tuple[Column, Column]) -> Column:
        """What the operation sets, as struct(v); NULL where it sets nothing."""
        out = F.when(new, F.struct(at_birth.alias("v")))
        for when, then in cases:
            out = out.when(done & when & then.isNotNull(), F.struct(then.alias("v")))
        return out

    given = lambda c: F.when(F.col(c) != "-1", F.col(c))
    sets = {
        "mode": assigned(F.coalesce("mode", F.lit(transition.DEFAULT_FILE_MODE)), (op == "chmod", F.col("mode"))),
        "owner": assigned(F.lit("root"), (op == "chown", given("uid"))),
        "group": assigned(F.lit("root"), (op == "chown", given("gid"))),
        "mtime": assigned(F.col("mtime"), (op.isin("create", "write", "truncate"), F.col("mtime"))),
    }
    end = F.coalesce("offset", F.lit(0)) + F.coalesce("data_length", F.octet_length("data"), F.lit(0))
    emptied = done & op.isin("create", "truncate")
    rows = rows.withColumns({f"_{c}": v for c, v in sets.items()} | {"_cuts": F.count_if(emptied).over(so_far)})
    base = Window.partitionBy(*keys, "_cuts").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    cut_to = F.when(emptied, F.when(op == "truncate", F.coalesce("length", F.lit(0))).otherwise(0))
    # Size from this range alone: since it was last cut, or, if it was not, what writes make it at least.
    rows = rows.withColumn("_reach", F.greatest(F.first(cut_to).over(base), F.max(F.when(done & (op == "write"), end)).over(base)))
    rows = rows.withColumns({"_reach_before": F.lag("_reach").over(own), "_cuts_before": F.coalesce(F.lag("_cuts").over(own), F.lit(0))})
    # Contents are known after an emptying, and after a write of a whole file whose bytes are logged.
    whole = F.octet_length("data") == F.coalesce("data_length", F.octet_length("data"))
    text = (
        F.when(is_create, F.lit("")).when((op == "truncate") & (F.coalesce("length", F.lit(0)) == 0), F.lit(""))
        .when((op == "write") & whole, F.col("data"))
    )
    # It holds if the write reaches the end of the file before it.
    least = F.when(op == "write", end)
    content = F.when(
        emptied | (done & (op == "write")),
        F.struct(text.alias("text"), least.alias("end"), F.col("_reach_before").alias("reach"), (F.col("_cuts_before") > 0).alias("cut")),
    )
    rows = rows.withColumn("_content", content)

    def known(written: Column, size_in: Column) -> Column:
        size = F.when(written["cut"], written["reach"]).otherwise(F.greatest(size_in, written["reach"]))
        fits = written["end"].isNull() | (written["end"] >= F.coalesce(size, F.lit(0)))
        return F.when(written.isNotNull(), F.struct(F.when(fits, written["text"]).alias("v")))

    values_in = {c: F.when(begun, F.struct(F.col(f"start.{c}").alias("v"))) for c in (*sets, "content")}
    if ranged:
        # One row for each range, and what the ranges before it leave to it.
        left = rows.groupBy(*keys).agg(
            *[_last(F.col(f"_{c}")).alias(f"_{c}") for c in sets], F.max("_cuts").alias("_cuts"), F.max_by("_reach", "seq").alias("_reach"),
            _last(F.col("_content")).alias("_content"), F.first("start").alias("start"),
        )
        left = left.withColumn("_part", F.count_if(F.col("_cuts") > 0).over(ranges))
        at_start = F.when(F.col("_part") == 0, F.coalesce("start.size", F.lit(0)))
        reach = F.max("_reach").over(Window.partitionBy("session", "path", "_part").orderBy("_range"))
        left = left.withColumn("_size", F.greatest(at_start, reach)).withColumn("size_in", F.coalesce(F.lag("_size").over(ranges), F.coalesce("start.size", F.lit(0))))
        left = left.withColumn("_content", known(F.col("_content"), F.col("size_in")))
        carried = left.select(*keys, "size_in", *[
            F.coalesce(F.last(f"_{c}", ignorenulls=True).over(earlier), value).alias(f"{c}_in") for c, value in values_in.items()
        ])
        rows = rows.join(carried, keys)
    else:
        rows = rows.withColumns({f"{c}_in": value for c, value in values_in.items()} | {"size_in": F.coalesce("start.size", F.lit(0))})
    running = lambda c, value: F.coalesce(F.last(value, ignorenulls=True).over(so_far), F.col(f"{c}_in"))["v"]
    size = F.when(F.col("_cuts") > 0, F.col("_reach")).otherwise(F.greatest("size_in", "_reach"))
    rows = rows.withColumns(
        {c: running(c, F.col(f"_{c}")) for c in sets}
        | {"content": running("content", known(F.col("_content"), F.col("size_in"))), "size": size, "is_dir": F.col("_dir")}
    )
    after = F.when(~(done & (op == "unlink")), F.struct(*STATE_COLUMNS))
    rows = rows.withColumn("_after", F.when(F.col("_there") | done, after))
    # The state before is that after the last operation that was done, in this range or in an earlier one.
    values = {"is_dir": F.col("_dir"), "size": F.col("size_in")} | {c: F.col(f"{c}_in")["v"] for c in (*sets, "content")}
    state_in = F.when(F.col("_there_in"), F.struct(*[values[c].alias(c) for c in STATE_COLUMNS]))
    last_done = F.last(F.when(done, F.struct(F.col("_after").alias("s"))), ignorenulls=True).over(before)
    rows = rows.withColumn("before", F.coalesce(last_done, F.struct(state_in.alias("s")))["s"])
    by_op = F.create_map(*[F.lit(x) for pair in transition.ERRNO.items() for x in pair])
    errno = F.when(is_create & (F.col("reason") == "is_directory"), "EIO").otherwise(by_op[op])
    # Both kinds of row come from one pass: an operation that was done gives two.
    kinds = F.when(done, F.array(F.lit("outcome"), F.lit("change"))).otherwise(F.array(F.lit("outcome")))
    is_change = F.col("kind") == "change"
    rows = rows.withColumns({"_errno": F.when(~done, errno), "_deleted": F.col("_after").isNull()})
    out = rows.select("session", "seq", "operation", "path", "reason", "_errno", "_deleted", "_after", "before", F.explode(kinds).alias("kind"))
    return out.select(
        "session", "seq", "operation", "kind", F.lit(0).alias("step"), "path", "reason", F.col("_errno").alias("errno"),
        F.when(is_change, F.col("_deleted")).alias("deleted"),
        *[F.when(is_change, F.col("_after")[c]).alias(c) for c in STATE_COLUMNS], F.when(is_change, F.col("before")).alias("before"),
    ), refused


def folded(initial: DataFrame, ops: DataFrame) -> DataFrame:
    """Rows of fold_files for the sessions that only touch files and of fold for the others."""
    rows, refused = fold_files(initial, ops)
    if refused.isEmpty():
        return rows
    rest = fold(initial.join(refused.withColumnRenamed("session", "snapshot_id"), "snapshot_id", "left_semi"), ops.join(refused, "session", "left_semi"), with_before=True)
    return rows.unionByName(rest)


def _attribute_ops(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    changing = prepared_ops(ops)
    tree_sessions = changing.filter(F.col("operation").isin(TREE_OPS)).select("session").distinct()
    return changing.join(tree_sessions, "session", "left_anti"), tree_sessions


def replay_attributes(initial: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replay without Python for sessions that only create, write, truncate, unlink and
    change attributes of files. Returns the entries, with content NULL (sizes are exact), and
    the sessions with directory, rename or link operations, which need replay().

    Two aggregates: when a path was last created, unlinked and cut; then what happened since."""
    changing, refused = _attribute_ops(ops)
    state = _initial_state(initial).join(refused, "session", "left_anti").drop("content")
    op, seq = F.col("operation"), F.col("seq")

    def last(kind: str) -> Column:
        return F.max(F.when(op == kind, seq))

    facts = changing.groupBy("session", "path").agg(
        last("unlink").alias("unlinked"), last("create").alias("created"),
        last("truncate").alias("cut"),
        F.max_by("length", F.when(op == "truncate", seq)).alias("cut_length"),
    )
    start = F.struct(*[c for c in STATE_COLUMNS if c != "content"])
    dirs = state.filter("is_dir").select("session", F.col("path").alias("parent"), F.lit(True).alias("_parent"))
    known = (
        facts.join(state.select("session", "path", start.alias("start")), ["session", "path"], "full")
        .withColumn("parent", F.coalesce(paths.parent(F.col("path")), F.lit("")))
        .join(dirs, ["session", "parent"], "left")
    )
    gone, made = F.coalesce("unlinked", F.lit(-1)), F.coalesce("created", F.lit(-1))
    from_start = F.col("start").isNotNull() & (F.col("start.is_dir") | F.col("unlinked").isNull())
    can_make = (F.col("_parent") | (F.col("parent") == "")) & (made > gone)
    alive = known.filter(from_start | F.coalesce(can_make, F.lit(False)))
    cut = F.coalesce("cut", F.lit(-1))
    plan = alive.select(
        "session", "path", "start", gone.alias("gone"), from_start.alias("from_start"),
        F.greatest(made, F.when(cut > gone, cut).otherwise(-1)).alias("reset"),
        F.when((cut > gone) & (cut > made), F.col("cut_length")).when(made > gone, 0)
        .otherwise(F.col("start.size")).alias("base_size"),
    )
    since = seq > F.col("gone")
    content_op = op.isin("create", "write", "truncate")

    def last_value(column: str, kind: str, condition: Column) -> Column:
        return F.max_by(column, F.when((op == kind) & since & condition, seq))

    given_mode = F.col("mode").isNotNull()
    given_uid = F.coalesce(F.col("uid"), F.lit("-1")) != "-1"
    given_gid = F.coalesce(F.col("gid"), F.lit("-1")) != "-1"
    end = F.coalesce("offset", F.lit(0)) + F.coalesce("data_length", F.octet_length("data"), F.lit(0))
    later = changing.join(plan.select("session", "path", "gone", "reset"), ["session", "path"]).groupBy("session", "path").agg(
        F.min(F.when((op == "create") & since, seq)).alias("born"),
        F.min_by("mode", F.when((op == "create") & since, seq)).alias("born_mode"),
        F.max(F.when((op == "write") & (seq > F.col("reset")), end)).alias("written"),
        last_value("mode", "chmod", given_mode).alias("new_mode"),
        F.max(F.when((op == "chmod") & since & given_mode, seq)).alias("mode_at"),
        last_value("uid", "chown", given_uid).alias("new_owner"),
        F.max(F.when((op == "chown") & since & given_uid, seq)).alias("owner_at"),
        last_value("gid", "chown", given_gid).alias("new_group"),
        F.max(F.when((op == "chown") & since & given_gid, seq)).alias("group_at"),
        F.max_by("mtime", F.when(content_op & since, seq)).alias("new_mtime"),
    )
    full = plan.join(later, ["session", "path"], "left")
    born = F.when(F.col("from_start"), -1).otherwise(F.col("born"))
    is_dir = F.coalesce(F.col("start.is_dir"), F.lit(False))

    def settled(value: str, at: str, kept: Column, fresh: Column) -> Column:
        unchanged = F.when(F.col("from_start"), kept).otherwise(fresh)
        return F.when(F.col(at) > born, F.coalesce(F.col(value), unchanged)).otherwise(unchanged)

    root = F.lit("root")
    entries = full.select(
        "session", "path", is_dir.alias("is_dir"),
        settled("new_mode", "mode_at", F.col("start.mode"),
                F.coalesce("born_mode", F.lit(transition.DEFAULT_FILE_MODE))).cast("int").alias("mode"),
        settled("new_owner", "owner_at", F.col("start.owner"), root).alias("owner"),
        settled("new_group", "group_at", F.col("start.group"), root).alias("group"),
        F.when(is_dir, F.col("start.mtime")).otherwise(F.coalesce("new_mtime", F.col("start.mtime"))).alias("mtime"),
        F.when(is_dir, F.col("start.size"))
        .otherwise(F.greatest(F.col("base_size"), F.coalesce("written", F.lit(0)))).cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("content"),
    )
    return _as_entries(entries), refused
