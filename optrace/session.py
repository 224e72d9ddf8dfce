"""Session settings the operators rely on, and lineage cutting."""

import shutil
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only; cluster sizing stays with whoever owns the session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Many-to-one lookups (children to their directory, ops to their session) meet hot
    # keys; splitting them is worth the extra exchange it may cost.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        stem = Path(tempfile.mkdtemp(prefix="optrace-")) / package.name
        context.addPyFile(shutil.make_archive(str(stem), "zip", package.parent, package.name))
        _shipped.add(context.applicationId)


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that the session's owner has not set, ship the package, return
    the session."""
    own = spark.conf.getAll
    for key, value in RUNTIME_SETTINGS.items():
        if key not in own:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one for local sessions without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="optrace-shared-"))
    return _local_root[0]


_local_root: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that every worker can reach."""
    return f"{shared_root(spark)}/{name}-{uuid4().hex}"


#: Parquet options for rows of megabytes each, such as blocks of texts: a row group, and so a page and what
#: a reader holds at a time, is one row. Else a writer collects 100 rows before it looks at their bytes, and
#: a reader takes all rows of a row group at once. A row's dictionary would save less than zstd does without.
ZSTD = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}
ROW_BY_ROW = ZSTD | {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"}


def kept(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written once as Parquet to a new shared folder, and read from there: later plans read the
    columns they need. options are the writer's, such as ROW_BY_ROW."""
    path = scratch_folder(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(app: str = "optrace", cpus: str = "8", partitions: str = "8") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tuned(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names (a scratch one if it names none)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)
