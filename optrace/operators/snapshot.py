"""Reads and edits of snapshot tables: one row per entry, keyed (snapshot_id, path)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optrace import constants as K
from optrace.functions import paths, text
from optrace.operators.grouping import ordered_groups
from optrace.schema import ATTRIBUTES

KEY = ["snapshot_id", "path"]
LISTING_NAMES = 1000  # names held by one listing row; listings come in parts of this many


def with_parent(entries: DataFrame) -> DataFrame:
    return entries.withColumn("parent", paths.parent(F.col("path")))


def parents(entries: DataFrame) -> DataFrame:
    """Every path that has a direct child: (snapshot_id, path)."""
    return (
        with_parent(entries).filter(F.col("parent").isNotNull())
        .select("snapshot_id", F.col("parent").alias("path")).distinct()
    )


def get_entry(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per key; attributes NULL where there is no such entry."""
    return keys.join(entries, KEY, "left")


def upsert(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace or add entries by path."""
    return entries.join(changes.select(*KEY), KEY, "left_anti").unionByName(changes)


def remove(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Delete entries by path; unknown paths are ignored."""
    return entries.join(keys.select(*KEY), KEY, "left_anti")


def with_visible_content(
    entries: DataFrame, focus: DataFrame | None = None, limit: int = K.INLINE_BYTES,
    include_contents: bool = True,
) -> DataFrame:
    """Adds body_shown: a file whose body belongs into a rendering. Files of at most limit
    bytes, files in focus (snapshot_id, path), and rows marked in an optional boolean column
    `inline` (state that never had a disk behind it)."""
    small = F.col("size") <= limit
    if "inline" in entries.columns:
        small = small | F.coalesce(F.col("inline"), F.lit(False))
    if focus is not None:
        wanted = focus.select(
            "snapshot_id", paths.normalize(F.col("path")).alias("path"), F.lit(True).alias("_focus")
        ).distinct()
        entries = entries.join(wanted, KEY, "left")
        small = small | F.coalesce(F.col("_focus"), F.lit(False))
    shown = entries.withColumn("body_shown", ~F.col("is_dir") & F.lit(include_contents) & small)
    return shown.drop("_focus")


def listing_rows(entries: DataFrame) -> DataFrame:
    """(snapshot_id, path, name) for every entry of every directory."""
    return (
        with_parent(entries).filter(F.col("parent").isNotNull())
        .select("snapshot_id", F.col("parent").alias("path"), "name")
    )


def _listing_json(names: Column, part: Column) -> Column:
    dotted = F.when(part == 0, paths.normalize_listing(names)).otherwise(names)
    return text.escaped_json(F.to_json(dotted))


def _listings(rows: DataFrame, names_per_row: int) -> DataFrame:
    groups = ordered_groups(rows, KEY, "name", "name", names_per_row)
    return groups.select(*KEY, "part", _listing_json(F.col("items"), F.col("part")).alias("listing"))


def list_directories(entries: DataFrame, names_per_row: int = LISTING_NAMES) -> DataFrame:
    """JSON listing of every directory: (snapshot_id, path, part, listing)."""
    full = _listings(listing_rows(entries), names_per_row)
    empty = (
        entries.filter("is_dir").select(*KEY)
        .join(parents(entries), KEY, "left_anti")
        .select(*KEY, F.lit(0).alias("part"), F.lit('[".",".."]').alias("listing"))
    )
    return full.unionByName(empty)


def readdir(entries: DataFrame, requests: DataFrame, names_per_row: int = LISTING_NAMES) -> DataFrame:
    """Requests with part and listing, a row per part. Unknown paths and files list as two dots."""
    asked = requests.withColumn("_path", paths.normalize(F.col("path")))
    wanted = asked.select("snapshot_id", F.col("_path").alias("path")).distinct()
    found = _listings(listing_rows(entries).join(wanted, KEY, "left_semi"), names_per_row)
    return (
        asked.join(found.withColumnRenamed("path", "_path"), ["snapshot_id", "_path"], "left")
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .withColumn("listing", F.coalesce("listing", F.lit('[".",".."]')))
        .drop("_path")
    )


def attributes_json() -> Column:
    return F.concat(
        F.lit('{"mode": '), F.col("mode").cast("string"),
        F.lit(', "size": '), F.col("size").cast("string"),
        F.lit(', "type": "'), F.when(F.col("is_dir"), "directory").otherwise("file"),
        F.lit('", "mtime": '), text.python_float(F.col("mtime")),
        F.lit(', "owner": '), text.json_string(F.col("owner")),
        F.lit(', "group": '), text.json_string(F.col("group")),
        F.lit("}"),
    )


def _point(entries: DataFrame, requests: DataFrame) -> DataFrame:
    asked = requests.withColumn("_path", paths.normalize(F.col("path")))
    state = entries.select("snapshot_id", F.col("path").alias("_path"), *ATTRIBUTES)
    return asked.join(state, ["snapshot_id", "_path"], "left")


def getattr_answer() -> Column:
    return F.when(F.col("is_dir").isNull(), K.NOT_FOUND_TEXT).otherwise(attributes_json())


def read_answer() -> Column:
    unreadable = F.concat(F.lit("ERROR: Cannot read file "), F.col("path"))
    return (
        F.when(F.col("is_dir").isNull(), K.NOT_FOUND_TEXT)
        .when(F.col("is_dir"), K.IS_DIRECTORY_TEXT)
        .when(F.col("content").isNull(), unreadable)
        .otherwise(text.sanitize_read(F.col("content")))
    )


def getattr(entries: DataFrame, requests: DataFrame) -> DataFrame:  # noqa: A001 - the operation's name
    """Requests with the attributes as JSON, or the error text."""
    return _point(entries, requests).select(*requests.columns, getattr_answer().alias("attributes"))


def read_file(
    entries: DataFrame, requests: DataFrame, offset: int | None = None, size: int | None = None
) -> DataFrame:
    """Requests with the cleaned content or the error text; with offset or size also `data`,
    that range of the content's bytes."""
    found = _point(entries, requests)
    columns = [*requests.columns, read_answer().alias("content")]
    if offset is not None or size is not None:
        start = (offset or 0) + 1
        data = F.encode(text.sanitize_read(F.col("content")), "UTF-8")
        part = F.substring(data, start, size if size is not None else 2**31 - 1 - start)
        columns.append(F.when(F.col("content").isNotNull() & ~F.col("is_dir"), part).alias("data"))
    return found.select(*columns)


def answer_queries(entries: DataFrame, requests: DataFrame, raw: str | None = None) -> DataFrame:
    """Answers routed by requests.operation: (requests..., part, answer). Operations that
    are no queries get the cleaned text of column raw."""
    columns = requests.columns
    op = F.col("operation")
    fallback = text.sanitize_read(F.col(raw)) if raw else F.lit("")
    point = _point(entries, requests.filter(op != "readdir")).select(
        *columns,
        F.lit(0).alias("part"),
        F.when(op == "getattr", getattr_answer()).when(op == "read", read_answer())
        .otherwise(fallback).alias("answer"),
    )
    listed = readdir(entries, requests.filter(op == "readdir")).select(
        *columns, "part", F.col("listing").alias("answer")
    )
    return point.unionByName(listed)


def total_content(entries: DataFrame) -> DataFrame:
    """Characters of readable file contents per snapshot."""
    readable = ~F.col("is_dir") & (F.col("path") != "")
    return entries.groupBy("snapshot_id").agg(
        F.coalesce(F.sum(F.when(readable, F.char_length("content"))), F.lit(0)).alias("total_chars")
    )


def _segments_special() -> Column:
    """Is the path, or a directory above it, one of the mount's own directories?"""
    dirs = F.when(F.col("is_dir"), paths.segments(F.col("path"))).otherwise(
        paths.segments(F.coalesce(paths.parent(F.col("path")), F.lit("")))
    )
    return F.exists(dirs, lambda s: s.isin(K.SPECIAL_DIRS))


def drop_special(entries: DataFrame) -> DataFrame:
    """Without the mount's own directories, their contents, and its own files."""
    own_file = ~F.col("is_dir") & F.col("name").isin(K.SPECIAL_FILES)
    return entries.filter(~_segments_special() & ~own_file)


def coverage(entries: DataFrame, min_files: int = 1) -> DataFrame:
    """Per snapshot: is there an empty and a populated directory below the root, and how many
    regular files; covered when all three needs are met."""
    walked = entries.filter(~_segments_special())
    children = parents(walked).withColumn("_has_child", F.lit(True))
    dirs = (
        walked.filter("is_dir AND path <> ''").select(*KEY)
        .join(children, KEY, "left")
        .select("snapshot_id", F.col("_has_child").isNull().alias("empty"), F.lit(0).alias("file"))
    )
    files = entries.filter(~F.col("is_dir") & ~F.col("name").isin(K.SPECIAL_FILES)).select(
        "snapshot_id", F.lit(None).cast("boolean").alias("empty"), F.lit(1).alias("file")
    )
    everyone = entries.filter("path = ''").select(
        "snapshot_id", F.lit(None).cast("boolean").alias("empty"), F.lit(0).alias("file")
    )
    counted = (
        dirs.unionByName(files).unionByName(everyone).groupBy("snapshot_id")
        .agg(
            F.coalesce(F.bool_or("empty"), F.lit(False)).alias("has_empty_dir"),
            F.coalesce(F.bool_or(~F.col("empty")), F.lit(False)).alias("has_populated_dir"),
            F.sum("file").alias("n_files"),
        )
    )
    covered = F.col("has_empty_dir") & F.col("has_populated_dir") & (F.col("n_files") >= min_files)
    return counted.withColumn("covered", covered)


def orphans(entries: DataFrame) -> DataFrame:
    """Entries whose parent is missing or not a directory."""
    dirs = entries.filter("is_dir").select("snapshot_id", F.col("path").alias("parent"))
    below = with_parent(entries).filter(F.col("parent").isNotNull())
    # Top-level entries need no row for the root.
    return below.filter("parent <> ''").join(dirs, ["snapshot_id", "parent"], "left_anti").select(*entries.columns)


def candidates(entries: DataFrame, seed: str) -> DataFrame:
    """One uniform pick per snapshot and kind, in one pass over the entries.

    Kinds: any, file, file16 (at least 16 bytes), dir and parent_dir (root allowed),
    empty_dir (below the root). NULL where a snapshot has no candidate."""
    # Merged: entries that are exploded behind an exchange look as few as the rows they come from, and
    # a broadcast of what seems small would put all of them on the driver.
    marked = (
        entries.select("snapshot_id", "path", "name", "is_dir", "size")
        .withColumn("_special_dir", _segments_special())
        .join(
            parents(entries.filter(~_segments_special())).withColumn("_has_child", F.lit(True)).hint("merge"),
            KEY, "left",
        )
    )
    is_file = ~F.col("is_dir") & ~F.col("name").isin(K.SPECIAL_FILES)
    walkable = ~F.col("_special_dir")
    is_dir = F.col("is_dir") & walkable
    has_child = F.coalesce(F.col("_has_child"), F.lit(False))

    def pick(kind: str, condition: Column) -> list[Column]:
        draw = F.sha2(F.concat_ws("|", F.lit(seed), F.lit(kind), "snapshot_id", "path"), 256)
        return F.min_by("path", F.when(condition, draw)).alias(kind)

    below_root = F.col("path") != ""
    return marked.groupBy("snapshot_id").agg(
        pick("any", below_root & ((F.col("is_dir") & walkable) | (is_file & walkable))),
        pick("file", is_file),
        pick("file16", is_file & (F.col("size") >= 16)),
        pick("dir", is_dir),
        pick("parent_dir", is_dir & has_child),
        pick("empty_dir", is_dir & below_root & ~has_child),
    )


def pick(entries: DataFrame, kind: str, seed: str) -> DataFrame:
    """One candidate per snapshot: (snapshot_id, path)."""
    return candidates(entries, seed).select("snapshot_id", F.col(kind).alias("path"))
