"""Uniform grid cells as join keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_of(cn: Column, ce: Column) -> Column:
    """One number for a cell's two (within 2^31 of zero)."""
    return F.shiftleft(cn.cast("long"), 32).bitwiseXOR(ce.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def cell_key(n: Column, e: Column, size: float | Column) -> Column:
    """The cell of a place."""
    return key_of(F.floor(n / size), F.floor(e / size))


def around_keys(n: Column, e: Column, size: float | Column) -> Column:
    """The nine cells at and around a place, as an array."""
    cn, ce = F.floor(n / size), F.floor(e / size)
    return F.array(*[key_of(cn + i, ce + j) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def segment_cells(segments: DataFrame, size: float, reach: float, listed: bool = False) -> DataFrame:
    """``segments`` (n1, e1, n2, e2) with a row for each ``cell`` that they pass within ``reach``; with ``listed`` each row has all of them, too (``cells``).

    A segment is cut into pieces no longer than a cell and each piece's box is
    widened, so the rows follow its length, not its box.
    """
    n = F.greatest(F.lit(1.0), F.ceil(F.greatest(F.abs(F.col("n2") - F.col("n1")), F.abs(F.col("e2") - F.col("e1"))) / size)).cast("int")

    def piece(k: Column) -> Column:
        a, b = k / n, (k + 1) / n
        at = lambda c, t: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * t
        low = lambda c: F.floor((F.least(at(c, a), at(c, b)) - reach) / size)
        high = lambda c: F.floor((F.greatest(at(c, a), at(c, b)) + reach) / size)
        across = lambda i: F.transform(F.sequence(low("e"), high("e")), lambda j: key_of(i, j))
        return F.flatten(F.transform(F.sequence(low("n"), high("n")), across))

    whole = segments.where("n1 is not null and e1 is not null and n2 is not null and e2 is not null")
    found = whole.withColumn("cells", F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), piece))))
    rows = found.withColumn("cell", F.explode("cells"))
    return rows if listed else rows.drop("cells")
