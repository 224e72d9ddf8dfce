"""The driver's tables as entries, operations, pairs and predictions."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from optrace.functions import paths
from optrace.functions.prompts import legacy_prompt
from optrace.schema import ENTRY_COLUMNS
from optrace.session import tuned

DIR_MODE, FILE_MODE = 0o755, 0o644
EPOCH = 1700000000.0

EVENT_OPERATIONS = {
    "click": "write", "view": "read", "purchase": "create", "signup": "chmod", "error": "unlink",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _dirs(folders: DataFrame, column: str) -> DataFrame:
    """Directory entries for every folder path and everything above it, root included."""
    path = F.explode(F.concat(F.array(F.lit("")), paths.ancestors(F.col(column))))
    found = folders.select("snapshot_id", path.alias("path")).distinct()
    return found.select(
        "snapshot_id", "path", paths.name(F.col("path")).alias("name"), F.lit(True).alias("is_dir"),
        F.lit(DIR_MODE).alias("mode"), F.lit("root").alias("owner"), F.lit("root").alias("group"),
        F.lit(EPOCH).alias("mtime"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("content"),
    )


def _doc_files(documents: DataFrame, snapshot: Column, path: Column) -> DataFrame:
    return documents.select(
        snapshot.alias("snapshot_id"), path.alias("path"),
        F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("name"),
        F.lit(False).alias("is_dir"), F.lit(FILE_MODE).alias("mode"), F.col("lang").alias("owner"),
        F.col("source").alias("group"), (F.lit(EPOCH) + F.col("doc_id") * 0.25).alias("mtime"),
        F.octet_length("text").cast("bigint").alias("size"), F.col("text").alias("content"),
    )


def _doc_path(*folders: str) -> Column:
    return F.concat_ws("/", *folders, F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")))


def doc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot: lang/source/doc_<id>.txt."""
    documents = table(spark, sf_dir, "documents")
    files = _doc_files(documents, F.lit("docs"), _doc_path("lang", "source"))
    folders = documents.select(F.lit("docs").alias("snapshot_id"), F.concat_ws("/", "lang", "source").alias("folder")).distinct()
    return files.unionByName(_dirs(folders, "folder")).select(ENTRY_COLUMNS)


def doc_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per language: source/doc_<id>.txt."""
    documents = table(spark, sf_dir, "documents")
    files = _doc_files(documents, F.col("lang"), _doc_path("source"))
    folders = documents.select(F.col("lang").alias("snapshot_id"), "source").distinct()
    return files.unionByName(_dirs(folders, "source")).select(ENTRY_COLUMNS)


def geo_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories region/nation, one file per customer, no contents."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("folder")
    )
    files = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lit("geo").alias("snapshot_id"), F.concat_ws("/", "folder", "c_name").alias("path"),
        F.col("c_name").alias("name"), F.lit(False).alias("is_dir"),
        F.when(F.col("c_custkey") % 2 == 0, 0o600).otherwise(0o644).alias("mode"),
        F.lower("c_mktsegment").alias("owner"), F.lit("staff").alias("group"),
        (F.lit(EPOCH) + F.col("c_custkey") * 0.5).alias("mtime"),
        (F.col("c_custkey") * 37).cast("bigint").alias("size"), F.lit(None).cast("string").alias("content"),
    )
    folders = places.select(F.lit("geo").alias("snapshot_id"), "folder")
    return files.unionByName(_dirs(folders, "folder")).select(ENTRY_COLUMNS)


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an operation log: a session per user, file d<k div 10>/f<k>."""
    return events_as_ops(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operations as a stream over the table's files."""
    schema = table(spark, sf_dir, "events").schema
    return events_as_ops(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"))


def events_as_ops(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    op = F.create_map(*[F.lit(x) for pair in EVENT_OPERATIONS.items() for x in pair])[F.col("event_type")]
    length = F.col("value").cast("bigint").cast("string")
    mode = F.when(k % 2 == 0, "0o100640").otherwise("0o100600")
    params = (
        F.when(F.col("event_type") == "click", F.create_map(F.lit("data_length"), length, F.lit("offset"), F.lit("0")))
        .when(F.col("event_type").isin("purchase", "signup"), F.create_map(F.lit("mode"), mode))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    return events.select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), op.alias("operation"),
        F.concat(F.lit("/d"), F.floor(k / 10), F.lit("/f"), k).alias("path"), "ts", params.alias("parameters"),
    )


def event_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree every session starts from: directories d0..d9 and the files with even number."""
    # Few bytes of users make many entries: AQE would put them together in one task, but for a number of partitions.
    users = table(spark, sf_dir, "events").select("user_id").distinct().select(F.col("user_id").cast("string").alias("snapshot_id"))
    users = users.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "snapshot_id")
    folder = F.concat(F.lit("d"), F.col("n"))
    dirs = _dirs(users.select("snapshot_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n")).withColumn("folder", folder), "folder")
    files = users.select("snapshot_id", F.explode(F.sequence(F.lit(0), F.lit(98), F.lit(2))).alias("k")).select(
        "snapshot_id", F.concat(F.lit("d"), F.floor(F.col("k") / 10), F.lit("/f"), "k").alias("path"),
        F.concat(F.lit("f"), "k").alias("name"), F.lit(False).alias("is_dir"), F.lit(FILE_MODE).alias("mode"),
        F.lit("root").alias("owner"), F.lit("root").alias("group"), F.lit(EPOCH).alias("mtime"),
        F.col("k").cast("bigint").alias("size"), F.lit(None).cast("string").alias("content"),
    )
    return dirs.unionByName(files).select(ENTRY_COLUMNS)


def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns answered by the next turn, as prompts of the four layouts in use: listing,
    read, change, and the older text layout."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("asked"))
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion")
    )
    where = F.concat(F.lit("/conv/"), F.col("conv_id"))

    def prompt(tag: str, op: str) -> Column:
        return F.concat(F.lit(f"<{tag}>\n{op}('"), where, F.lit("')\n---\n"), F.col("asked"))

    older = F.concat(
        F.lit("Current filesystem state:\n"), F.col("asked"), F.lit("\nOperation: "),
        F.when(F.col("turn") % 2 == 0, F.lit("flush('/a')")).otherwise("getattr('/a')"), F.lit("\nResult:"),
    )
    layout = (F.col("conv_id") + F.floor(F.col("turn") / 2)) % 4
    return asked.join(answered, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("example_id"),
        F.when(layout == 0, prompt("R", "readdir")).when(layout == 1, prompt("R", "read"))
        .when(layout == 2, prompt("W", "write")).otherwise(older).alias("prompt"),
        "completion",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as expected texts with five kinds of prediction."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    text = F.col("text")
    half = F.left(text, F.floor(F.char_length(text) / 2).cast("int"))
    predicted = (
        F.when(F.col("doc_id") % 5 == 0, text)
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("<think>why\nnot</think>\n  "), text, F.lit(" \n")))
        .when(F.col("doc_id") % 5 == 2, half)
        .when(F.col("doc_id") % 5 == 3, F.concat(text, F.lit("\nExplanation: done")))
        .otherwise(F.concat(F.translate(half, "aeinrst", "AEINRST"), F.lit(" #\n<think>open")))
    )
    return documents.join(labels, "doc_id").select(
        "doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("example_id"),
        F.concat(F.lit("q"), "quality").alias("operation_type"), text.alias("expected"), predicted.alias("predicted"),
    )


def state_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inside a small state document with its stop token, predicted with prefaces,
    tails and missing ends."""
    text, body, state = F.col("text"), F.col("body"), F.col("state")
    # Columns of their own: inlined, body and state would be worked out again in each place.
    marked = text.contains("<") | text.contains(">") | text.contains("&")
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.when(marked, F.translate("text", "<>&", "   ")).otherwise(text).alias("body")
    ).withColumn("state", F.concat(
        F.lit('<filesystem><file path="d'), "doc_id", F.lit('"><body>'), body, F.lit("</body></file></filesystem>")
    ))
    predicted = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Here it is: "), state, F.lit(" done")))
        .when(F.col("doc_id") % 4 == 1, F.concat(state, F.lit("\n<END_FS>\n")))
        .when(F.col("doc_id") % 4 == 2, F.left(state, F.char_length(state) - 20))
        .otherwise(F.concat(F.lit("no state, "), F.translate(body, "aeinrst", "AEINRST")))
    )
    return documents.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("example_id"), F.col("lang").alias("operation_type"),
        F.concat(state, F.lit("\n<END_FS>")).alias("expected"), predicted.alias("predicted"),
    )


def listing_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-name listings from consecutive documents' folders, predicted in other orders,
    with chatter, and with other names."""
    documents = table(spark, sf_dir, "documents")
    a = F.concat(F.lit('"a'), "doc_id", F.lit('"'))
    b = F.concat(F.lit('"b '), "source", F.lit('"'))
    c = F.concat(F.lit('"c'), "lang", F.lit('"'))

    def array(sep: str, *names: Column) -> Column:
        return F.concat(F.lit("["), F.concat_ws(sep, *names), F.lit("]"))

    expected = array(",", a, b, c)
    predicted = (
        F.when(F.col("doc_id") % 4 == 0, array(", ", c, a, b))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Sure: "), array(", ", a, b), F.lit(" or "), expected))
        .when(F.col("doc_id") % 4 == 2, F.concat(array(", ", a, a, b, c), F.lit(" [EOF] more")))
        .otherwise(F.lit(" nothing "))
    )
    return documents.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("example_id"), F.col("lang").alias("operation_type"),
        expected.alias("expected"), predicted.alias("predicted"),
    )


def legacy_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inside the scoring prompt of the older evaluation."""
    documents = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "state_change").otherwise("query")
    op = F.concat(F.lit("mkdir('/d"), "doc_id", F.lit("')"))
    return documents.select("doc_id", legacy_prompt(F.col("text"), op, kind).alias("prompt"))
