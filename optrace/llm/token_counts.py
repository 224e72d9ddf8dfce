"""Operator 3: token counts by source, language and tokenizer version, kept up by signed deltas.

A rollup is a folder of committed batches. A batch is the sum of its signed rows: an insert adds a
document and its tokens, a delete takes both away, a revision takes the old counts away and adds
the new ones. A batch is written to a path made from its id and becomes visible with Spark's
_SUCCESS file; committing an id that is there changes nothing, and one that broke off is written
anew. Totals are the sum over all batches; compaction sums them into one."""

from __future__ import annotations

from urllib.parse import quote
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, documents long, tokens long"

#: What the versions of the counter take as a token (no white space, no lookaround).
PATTERNS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"[A-Za-z\x{C0}-\x{24F}]+|[0-9]|[^\x20\x09-\x0DA-Za-z0-9\x{C0}-\x{24F}]+",
}


def counted(text: Column, version: str) -> Column:
    """Tokens of a text under a version; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[version])), F.lit(0)).cast("long")


def inserts(rows: DataFrame) -> DataFrame:
    """Signed rows of new documents; rows has source, lang, version and n_tokens."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("documents"), F.col("n_tokens").cast("long").alias("tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    """Signed rows of documents that go, with the counts they were inserted with."""
    return inserts(rows).select(*KEYS, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows of documents counted anew."""
    return deletes(before).unionByName(inserts(after))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


class Rollup:
    """Totals below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.covered: set[str] = set()
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _batches(self) -> list[str]:
        if not self.files.exists(self._path("")):
            return []
        names = [x.getPath().getName() for x in self.files.listStatus(self._path(""))]
        done = [x for x in names if x.startswith(("batch-", "base-")) and self.files.exists(self._path(f"{x}/_SUCCESS"))]
        bases = sorted(x for x in done if x.startswith("base-"))
        # A base holds the ids it sums up; the one that holds most stands for them.
        covered = {b: set(self.spark.read.parquet(f"{self.folder}/{b}/ids").toPandas()["id"]) for b in bases if self.files.exists(self._path(f"{b}/ids/_SUCCESS"))}
        best = max(covered, key=lambda b: (len(covered[b]), b), default=None)
        self.covered = covered.get(best, set())
        return ([best] if best else []) + [x for x in done if x.startswith("batch-") and x not in self.covered]

    def commit(self, batch_id: str, rows: DataFrame) -> bool:
        """Add signed rows under an id; False if the id has been committed before."""
        name = "batch-" + quote(batch_id, safe="")
        present = self._batches()
        if name in present or name in self.covered:
            return False
        _summed(rows).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens); keys whose documents and tokens are both back
        at zero have no row."""
        found = [f"{self.folder}/{x}" for x in self._batches()]
        if not found:
            return self.spark.createDataFrame([], SCHEMA)
        parts = [self.spark.read.schema(SCHEMA).parquet(x + ("/data" if "/base-" in x else "")) for x in found]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return _summed(rows).filter("documents <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Sum all committed batches into one base; their ids stay known."""
        batches = self._batches()
        ids = sorted(self.covered | {x for x in batches if x.startswith("batch-")})
        if not ids:
            return
        base = f"{self.folder}/base-{uuid4().hex}"
        self.totals().write.parquet(f"{base}/data")
        self.spark.createDataFrame([(x,) for x in ids], "id string").write.parquet(f"{base}/ids")
        self.files.create(self._path(base.rsplit("/", 1)[1] + "/_SUCCESS")).close()
