"""Operation logs: filters, the principal operation, distributions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optrace import constants as K
from optrace.functions import paths


def filter_ops(ops: DataFrame) -> DataFrame:
    """Operations on the useful list; both lists are compared in lower case."""
    op = F.lower(F.col("operation"))
    return ops.filter(op.isin(K.USEFUL_OPS) & ~op.isin(K.EXCLUDED_OPS))


def relativize(ops: DataFrame, root: str, repair_links: bool = False) -> DataFrame:
    """Mount root removed from paths and hard-link targets. Symlink rows are logged the other
    way round (path = what the link points to, target = the absolute link itself);
    repair_links strips their target as well."""
    def stripped(c: Column) -> Column:
        return F.replace(c, F.lit(root), F.lit(""))

    target = F.col("parameters")["target"]
    links = ["link", "symlink"] if repair_links else ["link"]
    fixed = F.transform_values(
        "parameters", lambda k, v: F.when(k == "target", stripped(v)).otherwise(v)
    )
    return ops.withColumn("path", stripped(F.col("path"))).withColumn(
        "parameters",
        F.when(F.col("operation").isin(links) & target.isNotNull(), fixed).otherwise(F.col("parameters")),
    )


def principal_op(ops: DataFrame) -> DataFrame:
    """Last operation of a session other than getattr and open, else its last operation.
    One aggregate; sessions without operations have no row."""
    is_main = ~F.col("operation").isin(K.MINOR_OPS)
    order = F.struct(is_main, F.col("seq"))
    row = F.struct("seq", "operation", "path", "ts", "parameters")
    return ops.groupBy("session").agg(F.max_by(row, order).alias("op")).select("session", "op.*")


def only_success(sessions: DataFrame, flag: str = "success") -> DataFrame:
    return sessions.filter(F.col(flag))


def op_class(op: Column) -> Column:
    return F.when(op.isin(K.USEFUL_OPS), "useful").when(op.isin(K.EXCLUDED_OPS), "excluded").otherwise("unknown")


def op_distribution(df: DataFrame, column: str = "operation") -> DataFrame:
    """(operation, n, class), by name."""
    return (
        df.groupBy(F.col(column).alias("operation")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("class", op_class(F.col("operation"))).orderBy("operation")
    )


def check_distribution(
    df: DataFrame, low: float = 0.015, high: float = 0.60, expected: list[str] | None = None,
    column: str = "operation",
) -> DataFrame:
    """(operation, n, share, within): shares strictly between the bounds; expected names
    that never occur appear with n = 0 and fail."""
    counts = df.groupBy(F.col(column).alias("operation")).agg(F.count(F.lit(1)).alias("n"))
    if expected:
        names = df.sparkSession.createDataFrame([(name,) for name in expected], "operation string")
        counts = (
            counts.unionByName(names.withColumn("n", F.lit(0).cast("bigint")))
            .groupBy("operation").agg(F.sum("n").alias("n"))
        )
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # over one row per name
    return (
        counts.withColumn("share", share)
        .withColumn("within", (F.col("share") > low) & (F.col("share") < high))
        .orderBy("operation")
    )


def missing_operations(df: DataFrame, expected: list[str], column: str = "operation") -> DataFrame:
    """Expected operation names that do not occur."""
    names = df.sparkSession.createDataFrame([(name,) for name in expected], "operation string")
    return names.join(df.select(F.col(column).alias("operation")).distinct(), "operation", "left_anti")


def normalized_paths(ops: DataFrame) -> DataFrame:
    """Log paths ('/a/b') as snapshot paths ('a/b')."""
    return ops.withColumn("path", paths.normalize(F.col("path")))
