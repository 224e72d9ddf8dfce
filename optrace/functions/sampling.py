"""Repeatable choices: everything is drawn from a hash of seed and key, never from rand()."""

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 15  # 16 digits overflow a signed long
SPACE = 16**HEX_DIGITS


def hash60(*parts: Column) -> Column:
    """Non-negative 60-bit number of the parts joined with '|'."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.left(digest, F.lit(HEX_DIGITS)), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """Double in [0, 1)."""
    return hash60(*parts) / F.lit(float(SPACE))


def choose(options: list[str], *parts: Column) -> Column:
    """One of the options, equally likely."""
    table = F.array(*[F.lit(o) for o in options])
    return F.element_at(table, (F.pmod(hash60(*parts), F.lit(len(options))) + 1).cast("int"))


def integer(low: int, high: int, *parts: Column) -> Column:
    """Whole number between low and high, both included."""
    return F.pmod(hash60(*parts), F.lit(high - low + 1)) + F.lit(low)


def weighted(weights: dict, *parts: Column) -> Column:
    """Key drawn by weight; weights are divided by their sum."""
    total = float(sum(weights.values()))
    edges, running = [], 0.0
    for weight in weights.values():
        running += weight
        edges.append(running / total)
    u = uniform(*parts)
    bounds = F.array(*[F.lit(e) for e in edges[:-1]])
    position = F.size(F.filter(bounds, lambda e: e <= u)) + 1
    return F.element_at(F.array(*[F.lit(k) for k in weights]), position)
