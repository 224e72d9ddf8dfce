"""Rendering of snapshots as XML or as a drawn tree.

A rendering is a table of text fragments with an order key, a row per tag or entry: it has this
shape whatever a snapshot's size, and needs no grouping. Fragments concatenated in the order of
(place, sort_key) are the document."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optrace import constants as K
from optrace.functions import paths, text
from optrace.operators.snapshot import KEY, parents, with_parent, with_visible_content

EMPTY_DOCUMENT = "<filesystem />"


def _escape_text(c: Column) -> Column:
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def _escape_attribute(c: Column) -> Column:
    c = _escape_text(c)
    for raw, shown in (('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def _attributes() -> Column:
    def attribute(key: str, value: Column) -> Column:
        return F.concat(F.lit(f' {key}="'), value, F.lit('"'))

    path = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    return F.concat(
        attribute("path", _escape_attribute(path)),
        attribute("name", _escape_attribute(F.coalesce("name", F.lit("")))),
        attribute("mode", F.coalesce(text.mode_to_octal(F.col("mode")), F.lit(""))),
        attribute("owner", _escape_attribute(F.coalesce("owner", F.lit("")))),
        attribute("group", _escape_attribute(F.coalesce("group", F.lit("")))),
        attribute("mtime", text.canonical_mtime(F.col("is_dir"))),
    )


def xml_fragments(
    entries: DataFrame, focus: DataFrame | None = None, limit: int = K.INLINE_BYTES,
    include_contents: bool = True,
) -> DataFrame:
    """(snapshot_id, sort_key, path, kind, text): an element per file, an opening and a closing tag
    per populated directory. Concatenated in key order they form the document's inside. Missing
    attributes are empty.

    Files need no join, so bodies are not shuffled here; only directories look up whether
    they have children."""
    path = F.col("path")
    files = with_visible_content(entries.filter("NOT is_dir"), focus, limit, include_contents)
    body = F.when(F.col("content") == "", "<body />").otherwise(
        F.concat(F.lit("<body>"), _escape_text(F.col("content")), F.lit("</body>"))
    )
    size = F.concat(F.lit(' size="'), F.coalesce(F.col("size"), F.lit(0)).cast("string"), F.lit('"'))
    head = F.concat(F.lit("<file"), _attributes(), size)
    file_text = F.when(
        F.col("body_shown") & F.col("content").isNotNull(),
        F.concat(head, F.lit(">"), body, F.lit("</file>")),
    ).otherwise(F.concat(head, F.lit(" />")))
    file_rows = files.select(
        "snapshot_id", paths.document_key(path).alias("sort_key"), "path", F.lit("file").alias("kind"),
        text.sanitize_text(file_text).alias("text"),
    )

    dirs = entries.filter("is_dir").drop("content").join(
        parents(entries).withColumn("_full", F.lit(True)), KEY, "left"
    )
    opening = F.concat(F.lit("<directory"), _attributes())
    tags = F.when(
        F.col("_full"),
        F.array(
            F.struct(paths.document_key(path).alias("k"), F.lit("open").alias("n"), F.concat(opening, F.lit(">")).alias("t")),
            F.struct(paths.closing_key(path).alias("k"), F.lit("close").alias("n"), F.lit("</directory>").alias("t")),
        ),
    ).otherwise(
        F.array(F.struct(paths.document_key(path).alias("k"), F.lit("empty").alias("n"), F.concat(opening, F.lit(" />")).alias("t")))
    )
    dir_rows = dirs.select("snapshot_id", "path", F.explode(tags).alias("tag")).select(
        "snapshot_id", F.col("tag.k").alias("sort_key"), "path", F.col("tag.n").alias("kind"), text.sanitize_text(F.col("tag.t")).alias("text")
    )
    return file_rows.unionByName(dir_rows)


def render_xml(
    entries: DataFrame, focus: DataFrame | None = None, limit: int = K.INLINE_BYTES,
    include_contents: bool = True, snapshots: DataFrame | None = None,
) -> DataFrame:
    """XML document per snapshot as rows (snapshot_id, place, sort_key, path, kind, text), its outer
    tags among them. With a table of snapshots, those without entries give the empty document."""
    inside = xml_fragments(entries, focus, limit, include_contents)
    known = entries.select("snapshot_id").distinct()
    no_key = F.lit(None).cast(inside.schema["sort_key"].dataType)

    def outer(of: DataFrame, rows: list[tuple[int, str, str]]) -> DataFrame:
        tag = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(k).alias("k"), F.lit(t).alias("t")) for p, k, t in rows])
        return of.select("snapshot_id", F.explode(tag).alias("o")).select(
            "snapshot_id", F.col("o.p").alias("place"), no_key.alias("sort_key"), F.lit(None).cast("string").alias("path"),
            F.col("o.k").alias("kind"), F.col("o.t").alias("text"),
        )

    out = inside.select("snapshot_id", F.lit(1).alias("place"), "sort_key", "path", "kind", "text").unionByName(
        outer(known, [(0, "start", "<filesystem>"), (2, "end", "</filesystem>")])
    )
    if snapshots is not None:
        bare = snapshots.select("snapshot_id").distinct().join(known, "snapshot_id", "left_anti")
        out = out.unionByName(outer(bare, [(0, "nothing", EMPTY_DOCUMENT)]))
    return out


def render_focused(entries: DataFrame, focus: DataFrame | None = None) -> DataFrame:
    """XML document with full bodies for the focus paths and small bodies otherwise."""
    return render_xml(entries, focus, K.INLINE_BYTES)


def order_text(sort_key: Column) -> Column:
    """The order key as one text that sorts alike, for names without control characters."""
    return F.array_join(F.transform(sort_key, lambda x: F.concat(F.when(x["rank"] == 0, "\x01").otherwise("\x02"), x["name"])), "")


def _dir_prefixes(last_children: DataFrame) -> DataFrame:
    """Per populated directory: the bars its children are drawn behind, and the name of its
    last child."""
    dirs = last_children.select("snapshot_id", F.col("parent").alias("path"))
    last_paths = last_children.select(
        "snapshot_id", paths.join(F.col("parent"), F.col("last_name")).alias("above"),
        F.lit(True).alias("_last"),
    )
    bars = (
        dirs.select(*KEY, F.posexplode_outer(paths.ancestors(F.col("path"))).alias("level", "above"))
        .join(last_paths, ["snapshot_id", "above"], "left")
        .withColumn(
            "bar",
            F.when(F.col("level").isNull(), "").when(F.col("_last"), K.TREE_BLANK).otherwise(K.TREE_BAR),
        )
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct("level", "bar"))).alias("bars"))
    )
    return bars.select(
        "snapshot_id", F.col("path").alias("parent"),
        F.array_join(F.col("bars.bar"), "").alias("prefix"),
    ).join(last_children, ["snapshot_id", "parent"])


def tree_fragments(
    entries: DataFrame, focus: DataFrame | None = None, limit: int = K.TREE_INLINE_BYTES,
    include_contents: bool = True,
) -> DataFrame:
    """(snapshot_id, sort_key, text): the line of an entry and, for shown files, its body."""
    is_dir, path = F.col("is_dir"), F.col("path")
    last_children = (
        with_parent(entries).filter(F.col("parent").isNotNull())
        .groupBy("snapshot_id", "parent")
        .agg(F.max(F.struct((~is_dir).alias("rank"), F.col("name").alias("name"))).alias("last"))
        .select("snapshot_id", "parent", F.col("last.name").alias("last_name"))
    )
    when = F.date_format(F.timestamp_micros((F.col("mtime") * 1e6).cast("long")), "MMM dd HH:mm")
    who = F.concat(F.col("owner"), F.lit(":"), F.col("group"))
    mode = text.mode_to_octal(F.col("mode"))

    def padded(c: Column, width: int) -> Column:
        return F.when(F.char_length(c) >= width, c).otherwise(F.rpad(c, width, " "))

    root = entries.filter(path == "").select(
        "snapshot_id", paths.tree_key(path, is_dir).alias("sort_key"),
        F.concat_ws(" ", padded(F.lit("/"), K.TREE_ROOT_WIDTH), F.lit("dir "), mode, who, when).alias("text"),
    )

    shown = with_visible_content(with_parent(entries).filter(path != ""), focus, limit, include_contents)
    placed = shown.join(_dir_prefixes(last_children), ["snapshot_id", "parent"], "left")
    is_last = F.col("name") == F.col("last_name")
    name_part = F.concat(
        F.col("prefix"), F.when(is_last, K.TREE_LAST).otherwise(K.TREE_MIDDLE), F.col("name")
    )
    line = text.strip_right(F.concat_ws(
        " ", padded(name_part, K.TREE_NAME_WIDTH), F.when(is_dir, "dir ").otherwise("file"), mode, who, when,
        F.when(is_dir, "").otherwise(text.format_size(F.col("size"))),
    ))
    margin = F.concat(
        F.col("prefix"), F.when(is_last, K.TREE_BLANK).otherwise(K.TREE_BAR), F.lit("    │ ")
    )
    body_lines = F.split(F.coalesce(F.col("content"), F.lit(K.UNREADABLE_BODY)), "\n", -1)
    kept = F.when(F.size(body_lines) == 1, body_lines).otherwise(F.filter(body_lines, lambda x: x != ""))
    body = F.concat(
        F.array(F.concat(margin, F.lit('<file_body path="'), path, F.lit('">'))),
        F.transform(kept, lambda x: F.concat(margin, x)),
        F.array(F.concat(margin, F.lit("</file_body>"))),
    )
    block = F.when(
        F.col("body_shown"), F.array_join(F.concat(F.array(line), body), "\n")
    ).otherwise(line)
    below = placed.select("snapshot_id", paths.tree_key(path, is_dir).alias("sort_key"), block.alias("text"))
    return root.unionByName(below)


def render_tree(
    entries: DataFrame, focus: DataFrame | None = None, limit: int = K.TREE_INLINE_BYTES,
    include_contents: bool = True,
) -> DataFrame:
    """(snapshot_id, sort_key, text): the drawn tree; fragments are joined by a line feed."""
    return tree_fragments(entries, focus, limit, include_contents)
