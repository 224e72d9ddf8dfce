"""Streams of operation logs: the trace as it is written, live state, live counts."""

from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from optrace.operators import transition
from optrace.operators.replay import prepared_ops
from optrace.operators.trace import filter_ops
from optrace.schema import LOG_LINE

STATE_SCHEMA = (
    "is_dir boolean, mode int, owner string, `group` string, mtime double, size bigint, content string"
)
LIVE_SCHEMA = f"session string, seq bigint, operation string, path string, ok boolean, reason string, deleted boolean, {STATE_SCHEMA}"


def stream_trace(spark: SparkSession, directory: str, useful_only: bool = True, files_per_trigger: int = 1000) -> DataFrame:
    """Log files as they appear; the file is the session. Lines that are no operation are
    skipped. seq is the logged time in microseconds."""
    raw = (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(directory)
        .select(F.from_json("value", LOG_LINE).alias("line"), F.col("_metadata.file_path").alias("session"))
        .filter("line.operation IS NOT NULL")
    )
    micros = (F.col("line.timestamp") * 1e6).cast("bigint")
    ops = raw.select(
        "session", micros.alias("seq"), F.col("line.operation").alias("operation"),
        F.col("line.path").alias("path"), F.timestamp_micros(micros).alias("ts"),
        F.col("line.parameters").alias("parameters"),
    )
    return filter_ops(ops) if useful_only else ops


def useful_stream(ops: DataFrame) -> DataFrame:
    """The useful operations of any stream of operations."""
    return filter_ops(ops)


class _MapStore:
    """Entries in keyed state; only the paths an operation touches are read or written."""

    def __init__(self, state):
        self.state = state

    def get(self, path):
        if self.state.containsKey((path,)):
            return list(self.state.getValue((path,)))
        # Every session starts with an empty root.
        return [True, transition.DEFAULT_DIR_MODE, "root", "root", 0.0, 0, None] if path == "" else None

    def put(self, path, entry):
        self.state.updateValue((path,), tuple(entry))

    def drop(self, path):
        self.state.removeKey((path,))

    def below(self, path):
        found = (key[0] for key in self.state.keys())
        return sorted(p for p in found if p and transition.parent_of(p) == path)


class LiveState(StatefulProcessor):
    """Applies the operations of a session as they arrive; failures leave its state alone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("entries", "path string", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        store, out = _MapStore(self.state), []
        columns = [c.strip().split(" ")[0].strip("`") for c in LIVE_SCHEMA.split(",")]
        ops = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for row in ops.astype(object).where(ops.notna(), None).to_dict("records"):
            common = {"session": key[0], "seq": row["seq"], "operation": row["operation"], "path": row["path"]}
            try:
                touched = transition.apply(store, SimpleNamespace(**row), False, False)
            except transition.Rejected as rejected:
                out.append({**common, "ok": False, "reason": str(rejected), "deleted": False})
                continue
            for path, _, entry in touched or [(row["path"], None, store.get(row["path"]))]:
                state = entry if entry is not None else [None] * 7
                out.append({**common, "path": path, "ok": True, "deleted": entry is None, **dict(zip(columns[7:], state))})
        yield pd.DataFrame(out, columns=columns)

    def close(self) -> None:
        pass


def live_state(ops: DataFrame) -> DataFrame:
    """Every change to every session's tree, as it happens; a session's state is kept for good.
    Needs the RocksDB state store (see use_rocksdb)."""
    changing = prepared_ops(ops)
    return changing.groupBy("session").transformWithStateInPandas(
        statefulProcessor=LiveState(), outputStructType=LIVE_SCHEMA, outputMode="Update",
        timeMode="None",
    )


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def live_distribution(ops: DataFrame) -> DataFrame:
    """Running count per operation name; write it in update mode."""
    return ops.groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


def write_counts(counts: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs a stream of running counts until nothing is left to read. Every batch writes its changed
    rows to a folder named by its id, so a batch that comes again after a restart replaces itself."""
    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts after the last batch that write_counts has kept: of every operation its latest."""
    rows = spark.read.schema("operation string, n bigint, batch bigint").parquet(folder)
    return rows.groupBy("operation").agg(F.max_by("n", "batch").alias("n"))
