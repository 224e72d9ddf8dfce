"""Training examples and prompt/completion pairs."""

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optrace import constants as K
from optrace.functions import paths, prompts
from optrace.functions.sampling import SPACE, hash60
from optrace.operators import replay as replays
from optrace.operators import trace
from optrace.operators.grouping import below_boundary, boundary_of, ordered_groups
from optrace.operators.render import xml_fragments
from optrace.operators.snapshot import getattr_answer, read_answer, readdir
from optrace.session import cut_lineage, kept

OPS_PER_ROW = 1000
DOCUMENT_TAGS = len("<filesystem></filesystem>")
#: Characters that any entry takes in a document.
SHORTEST_FRAGMENT = len('<directory path="" name="" mode="" owner="" group="" mtime="" />')


def within_budget(df: DataFrame, *columns: str, max_tokens: int = K.MAX_STATE_TOKENS) -> DataFrame:
    """Rows whose texts together are estimated at no more than max_tokens."""
    total = F.char_length(F.col(columns[0]))
    for column in columns[1:]:
        total = total + F.char_length(F.col(column))
    return df.filter(F.floor(total / K.CHARS_PER_TOKEN) <= max_tokens)


def bounded_documents(entries: DataFrame, focus: DataFrame | None, max_chars: int, key: Column, sides: dict[str, Column]) -> DataFrame:
    """(session, a document for each of sides): key tells the session and sides the side that a state's
    snapshot_id stands for. A document is NULL if there is none or it has more than max_chars characters.

    Longer states are never put together: those with too many entries to fit are left out before, which
    bounds a group, and of the others those go whose fragments' lengths sum up to more."""
    rendered = F.count_if(F.col("path").isNotNull() & F.col("is_dir").isNotNull())
    sizes = entries.groupBy("snapshot_id").agg(rendered.alias("n"))
    crowded = cut_lineage(sizes.filter(F.col("n") * SHORTEST_FRAGMENT > max_chars).select("snapshot_id"))
    if not crowded.isEmpty():
        entries = entries.join(crowded, "snapshot_id", "left_anti")
    size = F.char_length("text")
    fragment = F.struct("sort_key", F.when(size <= max_chars, F.col("text")).alias("text"))
    found = xml_fragments(entries, focus).groupBy(key.alias("session")).agg(
        *[F.sum(F.when(of, size)).alias(f"_{name}_n") for name, of in sides.items()],
        *[F.collect_list(F.when(of, fragment)).alias(f"_{name}") for name, of in sides.items()],
    )

    def document(name: str) -> Column:
        inside = F.array_join(F.transform(F.array_sort(F.col(f"_{name}")), lambda x: x["text"]), "")
        whole = F.concat(F.lit("<filesystem>"), inside, F.lit("</filesystem>"))
        return F.when(F.col(f"_{name}_n") + DOCUMENT_TAGS <= max_chars, whole)

    return found.select("session", *[document(name).alias(name) for name in sides])


def build_examples(
    initial: DataFrame, ops: DataFrame, focus: DataFrame | None = None,
    max_tokens: int = K.MAX_STATE_TOKENS, sessions: DataFrame | None = None,
) -> DataFrame:
    """One example per session from its principal operation: (session, initial_state,
    operation, result, operation_type, shell_command). session_operations gives the log behind
    them. sessions may give (session, shell_command, success); without it commands are null.
    An operation that failed, or a query that met no such entry, yields no example.

    A change maps the state before to the state after; a query maps a state to its answer.
    For reads the state is the one after the operation, with the read file in full.
    Examples over the token budget are left out."""
    # The log, the chosen operations and the folded rows are read several times below.
    useful = kept(trace.filter_ops(ops), "useful-operations")
    folded = replays.folded(initial, useful).drop("before").filter("kind = 'change' OR reason IS NOT NULL")
    rows = kept(folded, "folded-operations")
    failed = replays.outcomes(rows).filter("NOT ok").select("session", "seq")
    chosen = trace.principal_op(useful).join(failed, ["session", "seq"], "left_anti")
    if sessions is not None:
        chosen = chosen.join(sessions.filter("coalesce(success, true)").select("session", "shell_command"), "session")
    else:
        chosen = chosen.withColumn("shell_command", F.lit(None).cast("string"))
    chosen = kept(chosen, "chosen-operations")
    # Every entry carries the operation and the path its session asks for, so that no join is needed below.
    steps = chosen.select("session", "seq", "operation", paths.normalize(F.col("path")).alias("asked"))
    around = kept(replays.state_around(initial, replays.changes(rows), steps, keep=["operation", "asked"]), "states-around")
    max_chars = K.CHARS_PER_TOKEN * (max_tokens + 1) - 1

    # Which state a session needs rendered, under a key of its own so that one pass does all.
    op, side = F.col("operation"), F.col("side")
    needed = F.when(op == "read", side == "after").when(op.isin(K.QUERY_OPS), side == "before").otherwise(True)
    key = F.concat_ws("\x00", "side", "snapshot_id")
    states = around.filter(needed).select(
        key.alias("snapshot_id"), *[c for c in initial.columns if c != "snapshot_id"],
        ((op == "read") & (F.col("path") == F.col("asked"))).alias("inline"),
    )
    in_focus = None
    if focus is not None:
        changed = steps.filter("operation <> 'read'").select(
            F.col("session").alias("snapshot_id"),
            F.explode(F.when(op.isin(K.QUERY_OPS), F.array(F.lit("before"))).otherwise(F.array(F.lit("before"), F.lit("after")))).alias("side"),
        )
        in_focus = focus.join(changed, "snapshot_id").select(key.alias("snapshot_id"), "path")
    part = F.split("snapshot_id", "\x00")
    sides = {name: F.element_at(part, 1) == name for name in ("before", "after")}
    both = bounded_documents(states, in_focus, max_chars, F.element_at(part, 2), sides)
    answers = _answers(around.filter("side = 'after'").drop("side"), max_chars)
    kind = prompts.operation_type(F.col("operation"))
    rows = (
        chosen.withColumn("operation_type", kind)
        .join(both, "session")
        .join(answers.withColumnRenamed("snapshot_id", "session"), "session", "left")
    )
    initial_state = F.when(F.col("operation") == "read", F.col("after")).otherwise(F.col("before"))
    result = F.when(F.col("operation_type") == "query", F.col("answer")).otherwise(F.col("after"))
    examples = rows.select(
        "session", initial_state.alias("initial_state"),
        prompts.op_signature(F.col("operation"), F.col("path"), F.col("parameters")).alias("operation"),
        result.alias("result"), "operation_type", "shell_command",
    ).filter("initial_state IS NOT NULL AND result IS NOT NULL")
    return within_budget(examples, "initial_state", "operation", "result", max_tokens=max_tokens)


def _answers(entries: DataFrame, max_chars: int) -> DataFrame:
    """(snapshot_id, answer) of the query requests, one per snapshot. Entries carry their session's
    operation and the path it asked for."""
    entries = entries.filter(F.col("operation").isin(K.QUERY_OPS))
    point = entries.filter((F.col("operation") != "readdir") & (F.col("path") == F.col("asked"))).filter(
        "operation = 'getattr' OR NOT is_dir"
    ).select("snapshot_id", F.when(F.col("operation") == "getattr", getattr_answer()).otherwise(read_answer()).alias("answer"))
    # Parts are put together only where the whole fits the budget.
    listable = entries.filter("operation = 'readdir'")
    asked_dirs = listable.filter(F.col("is_dir") & (F.col("path") == F.col("asked"))).select("snapshot_id", "path").distinct()
    parts = readdir(listable, asked_dirs).select("snapshot_id", "part", "listing")
    fitting = parts.groupBy("snapshot_id").agg(F.sum(F.char_length("listing")).alias("n")).filter(F.col("n") <= max_chars)
    inside = F.transform(F.array_sort(F.collect_list(F.struct("part", "listing"))), lambda x: F.substring(x["listing"], F.lit(2), F.char_length(x["listing"]) - 2))
    listed = parts.join(fitting.select("snapshot_id"), "snapshot_id", "left_semi").groupBy("snapshot_id").agg(
        F.concat(F.lit("["), F.array_join(inside, ","), F.lit("]")).alias("answer")
    )
    return point.unionByName(listed)


def session_operations(ops: DataFrame, ops_per_row: int = OPS_PER_ROW) -> DataFrame:
    """(session, part, fuse_operations): the useful operations of a session in log order, in
    consecutive parts of ops_per_row operations."""
    # Sorting needs comparable values, so the map travels as its entries.
    op = F.struct("operation", "path", "ts", F.map_entries("parameters").alias("parameters"))
    useful = trace.filter_ops(ops).withColumn("_op", op)
    groups = ordered_groups(useful, ["session"], "seq", "_op", ops_per_row)
    restored = F.transform(
        "items", lambda o: o.withField("parameters", F.map_from_entries(o["parameters"]))
    )
    return groups.select("session", "part", restored.alias("fuse_operations"))


def to_pairs(examples: DataFrame) -> DataFrame:
    """Examples as (example_id, prompt, completion)."""
    kind = F.col("operation_type")
    return examples.select(
        F.col("session").alias("example_id"),
        prompts.build_prompt(kind, F.col("operation"), F.col("initial_state")).alias("prompt"),
        prompts.build_completion(kind, F.col("result")).alias("completion"),
    )


def _cut_mark(columns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(F.col(column).contains(K.TRUNCATION_MARK), F.lit(False))
    return found


def assert_untruncated(pairs: DataFrame, *columns: str) -> DataFrame:
    """The same rows; the job fails on the first text with the truncation mark."""
    columns = columns or ("prompt", "completion")
    message = F.lit("truncation mark found; texts must be complete")
    checked = F.when(_cut_mark(columns), F.raise_error(message).cast("string")).otherwise(F.col(columns[0]))
    return pairs.withColumn(columns[0], checked)


def quarantine(pairs: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(clean, marked) by the truncation mark."""
    columns = columns or ("prompt", "completion")
    return pairs.filter(~_cut_mark(columns)), pairs.filter(_cut_mark(columns))


def drop_excluded(pairs: DataFrame, both_layouts: bool = True) -> DataFrame:
    """Without pairs whose prompt names an excluded operation. The older reading alone
    (both_layouts=False) sees 'unknown' in every prompt of the current layout."""
    op = prompts.prompt_operation if both_layouts else prompts.legacy_operation
    return pairs.filter(~op(F.col("prompt")).isin(K.EXCLUDED_OPS))


def split_key(id_column: str, seed: str = K.SPLIT_SEED) -> Column:
    return hash60(F.lit(seed), F.col(id_column))


def split(pairs: DataFrame, ratio: float = K.TRAIN_RATIO, seed: str = K.SPLIT_SEED, id_column: str = "example_id") -> DataFrame:
    """Adds split = 'train' or 'test' by comparing the hash of the id with the ratio: no
    shuffle, no count, stable when data are added. The share is met up to chance."""
    is_train = split_key(id_column, seed) < F.lit(int(ratio * SPACE))
    return pairs.withColumn("split", F.when(is_train, "train").otherwise("test"))


def split_exact(pairs: DataFrame, ratio: float = K.TRAIN_RATIO, seed: str = K.SPLIT_SEED, id_column: str = "example_id") -> DataFrame:
    """Adds split with exactly floor(ratio * n) train rows: those with the smallest hashes."""
    boundary = boundary_of(pairs, lambda n: floor(ratio * n), split_key(id_column, seed), id_column)
    key = split_key(id_column, seed)
    is_train = below_boundary(key, id_column, boundary)
    return pairs.withColumn("split", F.when(is_train, "train").otherwise("test"))


def take_quota(df: DataFrame, n: int, seed: str = K.SPLIT_SEED, id_column: str = "example_id") -> DataFrame:
    """n rows chosen by hash; all rows if there are fewer."""
    boundary = boundary_of(df, n, split_key(id_column, seed), id_column)
    return df.filter(below_boundary(split_key(id_column, seed), id_column, boundary))


def split_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "test").alias("test"),
    )


def to_chat(pairs: DataFrame) -> DataFrame:
    """Adds the two-message array and the marked-up text."""
    prompt, completion = F.col("prompt"), F.col("completion")
    return pairs.withColumn("messages", prompts.chat_messages(prompt, completion)).withColumn(
        "text", prompts.chat_text(prompt, completion)
    )


def training_rows(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("text", prompts.training_text(F.col("prompt"), F.col("completion")))


def legacy_examples(pairs: DataFrame) -> DataFrame:
    """Older prompts taken apart: (example_id, initial_state, operation, operation_type, result)."""
    parsed = pairs.withColumn("_parsed", prompts.parse_legacy_prompt(F.col("prompt")))
    return parsed.select("example_id", "_parsed.*", F.col("completion").alias("result"))
