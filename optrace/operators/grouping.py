"""Groups that may be far too large for one task.

Rows are sorted across the cluster by range, numbered within their key from a narrow table of counts
per slice, and collected in parts of a fixed number of rows. Every key has this one shape,
whatever its size, so no task ever holds more than a part and nothing is left out."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from optrace.session import cut_lineage


def ordered_groups(df: DataFrame, keys: list[str], order: str, value: str, rows_per_part: int) -> DataFrame:
    """Values of every key in order: (keys, part, n_parts, items), rows_per_part items in each part
    but the last; items follow on from part to part."""
    rows = df.select(*keys, F.col(order).alias("_order"), F.col(value).alias("_value"))
    # Slices must not change between the two uses below.
    sliced = cut_lineage(rows.repartitionByRange(*keys, "_order").withColumn("_slice", F.spark_partition_id()))
    by_key = Window.partitionBy(*keys)
    before = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_slice", (F.sum("_n").over(by_key.orderBy("_slice")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by_key).alias("_all"),
    )
    within = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("_order"))
    placed = sliced.withColumn("_at", within).join(before, [*keys, "_slice"]).withColumn("_at", F.col("_before") + F.col("_at") - 1)
    items = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_value"))), lambda x: x["_value"])
    return placed.groupBy(*keys, F.floor(F.col("_at") / rows_per_part).cast("int").alias("part")).agg(
        F.ceil(F.first("_all") / rows_per_part).cast("int").alias("n_parts"), items.alias("items")
    )


#: Size of a quantile sketch, share of the rows by which its answer is widened to either side, and rows
#: that are settled one by one.
SKETCH, MARGIN, SETTLED = 4096, 0.005, 200_000


def boundary_of(df: DataFrame, n: int | Callable[[int], int], key: Column, tie: str, settled: int = SETTLED) -> tuple | None:
    """(key, tie) of the n-th smallest row by those two, exactly, for any n; None if there are
    fewer rows, and an impossible (-1, None) for n <= 0. n may be a function of the number of rows.

    key is a 60-bit number. One pass with a quantile sketch gives a bracket around it, a second counts
    the rows below and settles the few inside; a bracket with more than settled rows is narrowed in the
    same way. The driver sees counts, sketches and one row."""
    keyed = df.select(key.alias("_key"), F.col(tie).alias("_tie"))
    spark = df.sparkSession
    low, high, below = -1, 1 << 60, 0  # the row is in low < key <= high, with so many rows before
    inside = keyed
    while True:
        found = inside.agg(F.count("_key").alias("n"), F.kll_sketch_agg_bigint("_key", F.lit(SKETCH)).alias("sketch")).first()
        if low < 0:
            n = n(found["n"]) if callable(n) else n
            if n <= 0:
                return -1, None
            if n > found["n"]:
                return None
        if found["n"] <= settled:
            break
        ranks = [min(1.0, max(0.0, (n - below) / found["n"] + x)) for x in (-MARGIN, MARGIN)]
        sketch = spark.createDataFrame([(found["sketch"],)], "sketch binary")
        ends = sketch.select(*[F.kll_sketch_get_quantile_bigint("sketch", F.lit(x)).alias(f"q{i}") for i, x in enumerate(ranks)]).first()
        one, two = (low if ranks[0] == 0 else ends[0] - 1), (high if ranks[1] == 1 else ends[1])
        seen, wanted = Observation(), n - below
        counted = inside.observe(seen, F.count_if(F.col("_key") <= one).alias("below"), F.count_if(F.col("_key") <= two).alias("upto"))
        narrow = counted.filter((F.col("_key") > one) & (F.col("_key") <= two))
        expected = int(found["n"] * 2 * MARGIN) + 1
        # The rows inside come in the same pass if few are expected; the place of the wanted one is known after it.
        rows = narrow.orderBy("_key", "_tie").limit(2 * expected if 2 * expected <= settled else 1).collect()
        upto, before = seen.get["upto"], seen.get["below"]
        if before < wanted <= upto:
            if wanted - before <= len(rows):
                return tuple(rows[wanted - before - 1])
            if (one, two) == (low, high):
                break
            low, high, below = one, two, below + before
        elif wanted <= before:  # the sketch was wrong by more than MARGIN
            high = one
        else:
            low, below = two, below + upto
        inside = keyed.filter((F.col("_key") > low) & (F.col("_key") <= high))
    return tuple(inside.orderBy("_key", "_tie").limit(n - below).tail(1)[0])


def below_boundary(key: Column, tie: str, boundary: tuple | None) -> Column:
    """Is the row among those boundary_of counted?"""
    if boundary is None:
        return F.lit(True)
    return (key < boundary[0]) | ((key == boundary[0]) & (F.col(tie) <= F.lit(boundary[1])))
