"""Prompt, completion and signature texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from optrace import constants as K
from optrace.functions import text


def operation_type(op: Column) -> Column:
    return F.when(op.isin(K.QUERY_OPS), "query").otherwise("state_change")


def op_signature(op: Column, path: Column, params: Column) -> Column:
    """op('path', key=value, ...) with bare values, as in the training prompts."""
    head = F.concat(op, F.lit("('"), path, F.lit("'"))
    rendered = F.array_join(
        F.transform(
            F.map_entries(params),
            lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))),
        ),
        ", ",
    )
    return F.when(
        F.coalesce(F.size(params), F.lit(0)) > 0, F.concat(head, F.lit(", "), rendered, F.lit(")"))
    ).otherwise(F.concat(head, F.lit(")")))


def op_call(op: Column, args: Column, params: Column) -> Column:
    """op(args, key=value) as the serving side writes it: strings quoted, numbers and the
    written data bare, NULL as None. Maps carry text only, so numbers are told by key."""

    def quoted(value: Column) -> Column:
        return F.coalesce(text.python_repr(value), F.lit("None"))

    def pair(e: Column) -> Column:
        bare = e["key"].isin(K.UNQUOTED_KEYS + ["data"])
        value = F.when(bare, F.coalesce(e["value"], F.lit("None"))).otherwise(quoted(e["value"]))
        return F.concat(e["key"], F.lit("="), value)

    parts = F.concat(
        F.transform(args, quoted),
        F.coalesce(F.transform(F.map_entries(params), pair), F.array().cast("array<string>")),
    )
    return F.concat(op, F.lit("("), F.array_join(F.filter(parts, lambda p: p != ""), ", "), F.lit(")"))


def build_prompt(kind: Column, signature: Column, state: Column) -> Column:
    tag = F.when(kind == "state_change", "<W>").otherwise("<R>")
    return F.concat_ws("\n", tag, signature, F.lit("---"), state)


def build_completion(kind: Column, result: Column) -> Column:
    return F.when(kind == "state_change", F.concat(result, F.lit("\n" + K.STOP_TOKEN))).otherwise(result)


def operation_line(prompt: Column) -> Column:
    """First line that is neither blank nor a short tag such as <W>; '' if there is none."""

    def first_of(candidates: Column) -> Column:
        def telling(line: Column) -> Column:
            tag = line.startswith("<") & line.endswith(">") & (F.char_length(line) <= 4)
            return (line != "") & ~tag

        return F.get(F.filter(F.transform(candidates, text.strip), telling), F.lit(0))

    # The line is nearly always among the first three; only else split the whole state.
    head = F.slice(F.split(prompt, text.LINE_BREAK, 4), 1, 3)
    return F.coalesce(first_of(head), first_of(F.split(prompt, text.LINE_BREAK, -1)), F.lit(""))


def with_contract(prompt: Column, variant: str = "eval") -> Column:
    """Prompt behind the output contract its operation calls for. The training and the
    evaluation side word the state contract differently: variant 'train' or 'eval'."""
    state = {"eval": K.CONTRACT_STATE_EVAL, "train": K.CONTRACT_STATE_TRAIN}[variant]
    line = F.lower(operation_line(prompt))
    contract = (
        F.when(line.contains("readdir("), K.CONTRACT_LISTING)
        .when(line.startswith("read(") | line.contains(" read("), K.CONTRACT_READ)
        .otherwise(state)
    )
    return F.concat(F.lit(K.CONTRACT_HEADER), contract, F.lit("\n\n"), prompt)


def legacy_operation(prompt: Column) -> Column:
    """Operation name of the older 'Operation: ...' prompts; 'unknown' elsewhere."""
    line = text.strip(F.regexp_extract(prompt, rf"Operation:{text.BLANK}*([^\n]+)", 1))
    called = F.regexp_extract(line, rf"^([a-zA-Z_]+){text.BLANK}*\(", 1)
    word = F.regexp_extract(line, rf"^((?!{text.BLANK}).)+", 0)
    return F.coalesce(F.nullif(F.lower(F.coalesce(F.nullif(called, F.lit("")), word)), F.lit("")), F.lit("unknown"))


def operation_name(signature: Column) -> Column:
    """Text before the bracket; 'shell_command' for anything that is not a call."""
    return F.when(signature.contains("("), F.substring_index(signature, "(", 1)).otherwise("shell_command")


def prompt_operation(prompt: Column) -> Column:
    """Operation of either prompt layout."""
    legacy = legacy_operation(prompt)
    line = operation_line(prompt)
    current = F.when(line.rlike(r"^[a-z_]+\("), F.substring_index(line, "(", 1))
    return F.when(legacy == "unknown", F.coalesce(current, F.lit("unknown"))).otherwise(legacy)


def parse_legacy_prompt(prompt: Column) -> Column:
    """struct(initial_state, operation, operation_type) of an older prompt. The type test is
    by substring, so an operand such as 'utils' counts as a listing."""
    end = F.char_length(prompt)
    start = F.locate(K.LEGACY_STATE_HEADING, prompt)
    tail = F.substring(prompt, start, end)
    newline = F.locate("\n", tail)
    body = F.when((start > 0) & (newline > 0), F.substring(tail, newline, end)).otherwise("")
    state = text.strip(F.substring_index(body, "\n" + K.LEGACY_OPERATION_HEADING, 1))
    line = F.regexp_extract(body, "\\n" + K.LEGACY_OPERATION_HEADING + "([^\\n]*)", 1)
    operation = text.strip(F.replace(line, F.lit(K.LEGACY_OPERATION_HEADING), F.lit("")))
    asks = F.lit(False)
    for word in K.LEGACY_QUERY_WORDS:
        asks = asks | F.lower(operation).contains(word)
    return F.struct(
        state.alias("initial_state"),
        operation.alias("operation"),
        F.when(asks, "query").otherwise("state_change").alias("operation_type"),
    )


def legacy_prompt(state: Column, operation: Column, kind: Column) -> Column:
    """Scoring prompt of the older evaluation."""
    shape = F.when(kind == "state_change", "virtual filesystem state tree").otherwise("command output")
    return F.concat(
        F.lit(K.LEGACY_INTRO + "\n\nInitial virtual filesystem state:\n"), state,
        F.lit("\n\nOperation: "), operation,
        F.lit("\n\nExpected result format: "), shape,
        F.lit("\n\nResult:"),
    )


def training_text(prompt: Column, completion: Column) -> Column:
    return F.concat(with_contract(prompt, "train"), F.lit("\n"), completion)


def chat_messages(prompt: Column, completion: Column) -> Column:
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(turn("user", prompt), turn("assistant", completion))


def chat_text(prompt: Column, completion: Column) -> Column:
    return F.concat(
        F.lit("<|im_start|>user\n"), prompt,
        F.lit("<|im_end|>\n<|im_start|>assistant\n"), completion, F.lit("<|im_end|>"),
    )
