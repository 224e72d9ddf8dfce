"""Paths inside a snapshot. The root is '', its name is '/', separators are single slashes."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(c: Column) -> Column:
    """Outer slashes removed; NULL and '/' give the root ''."""
    return F.coalesce(F.regexp_replace(c, "^/+|/+$", ""), F.lit(""))


def name(path: Column) -> Column:
    return F.when(path == "", "/").otherwise(F.substring_index(path, "/", -1))


def parent(path: Column) -> Column:
    """Parent path; NULL for the root. (Few mentions of path keep nested plans small.)"""
    return F.when(path != "", F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1))


def segments(path: Column) -> Column:
    """Path as an array of names; empty for the root."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/", -1))


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/", -1)))


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; '' when the name has none."""
    return F.lower(F.regexp_extract(name(path), r"^\.*[^.].*\.([^.]*)$", 1))


def join(base: Column, child: Column) -> Column:
    return F.when(base == "", child).otherwise(F.concat(base, F.lit("/"), child))


def prefix(path: Column, n: Column) -> Column:
    """First n names of a path."""
    return F.call_function("substring_index", path, F.lit("/"), n)


def ancestors(path: Column) -> Column:
    """Every proper prefix below the root, then the path itself: a, a/b, a/b/c."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(path, "/", -1), lambda _, i: prefix(path, i + 1))
    )


def is_direct_child(path: Column, directory: Column) -> Column:
    return parent(path).eqNullSafe(directory)


def resolve(base: Column, link: Column) -> Column:
    """Path a link text names when read in directory base; '.' and '..' are worked off."""
    full = F.when(link.startswith("/"), link).otherwise(F.concat_ws("/", base, link))

    def step(kept: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), kept)
            .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(part)))
        )

    return F.array_join(
        F.aggregate(F.split(full, "/", -1), F.array().cast("array<string>"), step), "/"
    )


def document_key(path: Column) -> Column:
    """Depth-first order, names ascending per level; nested texts close after their children."""
    return F.transform(segments(path), lambda n: F.struct(F.lit(0).alias("rank"), n.alias("name")))


def closing_key(path: Column) -> Column:
    return F.concat(document_key(path), F.array(F.struct(F.lit(1).alias("rank"), F.lit("").alias("name"))))


def tree_key(path: Column, is_dir: Column) -> Column:
    """Depth-first order with directories before files on every level."""
    last = F.size(segments(path)) - 1
    return F.transform(
        segments(path),
        lambda n, i: F.struct(((i == last) & ~is_dir).cast("int").alias("rank"), n.alias("name")),
    )


def normalize_listing(names: Column) -> Column:
    """'.', '..', then the other names once each in ascending order."""
    dots = F.array(F.lit("."), F.lit(".."))
    return F.concat(dots, F.array_sort(F.array_except(names, dots)))
