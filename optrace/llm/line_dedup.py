"""Operator 6: boilerplate lines by their frequency within a site, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a site's pages above which a line is boilerplate, and pages that must hold it: navigation
#: and notices stand on few of a site's pages each, a sentence of its own text hardly ever on five.
RATIO, LEAST_PAGES = 0.005, 5


def _pair(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit digests; nulls differ from every value."""
    plain = [x for c in columns for x in (c, c.isNull())]
    return F.xxhash64(F.lit("one"), *plain), F.xxhash64(F.lit("two"), *plain)


def _line(x: Column) -> Column:
    one, two = F.xxhash64(F.lit("one"), x), F.xxhash64(F.lit("two"), x)
    return F.struct(one.alias("one"), two.alias("two"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that df has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drop_boilerplate(documents: DataFrame, site: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Every row of documents (doc_id, text, the site column and any others), text without its
    site's boilerplate lines, and n_dropped, the number of lines that went.

    A page is a distinct text of a site: copies of one page count once, so a page published many
    times does not make its own lines boilerplate. A line is boilerplate if it is not empty, on
    least_pages pages at least, and on more than ratio of the site's pages. Lines are separated
    by line feeds and compared as they are. Rows without text or site stay as they are; a
    column n_dropped is replaced.

    Lines are exploded as digests only: within a page once, then by (site, line, page), then
    counted by (site, line), each with partial aggregation, so a site or line with a third of all
    rows is spread. Texts are moved once, by the digest of their page."""
    documents = documents.drop("n_dropped")
    host, text = F.col(site), F.col("text")
    page_one, page_two = _pair(host, text)
    one, two, found_lines = free_names(documents, "_p1", "_p2", "_hits")  # beside the caller's columns
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), _line))
    narrow = documents.filter(host.isNotNull() & text.isNotNull()).select(
        host.alias("_site"), page_one.alias("_p1"), page_two.alias("_p2"), lines.alias("_lines")
    )
    pages = narrow.select("_site", "_p1", "_p2").distinct().groupBy("_site").agg(F.count(F.lit(1)).alias("_pages"))
    held = narrow.select("_site", "_p1", "_p2", F.explode("_lines").alias("_line")).select("_site", "_p1", "_p2", "_line.one", "_line.two")
    held = held.distinct()
    counted = held.groupBy("_site", "one", "two").agg(F.count(F.lit(1)).alias("_with")).filter(F.col("_with") >= least_pages)
    common = counted.join(pages, "_site").filter(F.col("_with") > F.lit(ratio) * F.col("_pages")).select("_site", "one", "two")
    hits = held.join(common, ["_site", "one", "two"], "left_semi").groupBy(F.col("_p1").alias(one), F.col("_p2").alias(two)).agg(
        F.collect_set(F.struct("one", "two")).alias(found_lines)
    )
    keyed = documents.withColumns({one: page_one, two: page_two})
    found = keyed.join(hits, [one, two], "left")
    split = F.split(text, "\n")
    kept = F.filter(split, lambda x: ~F.array_contains(F.col(found_lines), _line(x)))
    marked = F.col(found_lines).isNotNull()
    return found.withColumns({
        "text": F.when(marked, F.array_join(kept, "\n")).otherwise(text),
        "n_dropped": F.when(marked, F.size(split) - F.size(kept)).otherwise(F.lit(0)).cast("long"),
    }).select(*documents.columns, "n_dropped")
