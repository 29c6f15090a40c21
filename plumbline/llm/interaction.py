"""Filter interaction audit: who removes what in every order of five filters, by multilinear extension.

A document is a mask of the filters it fails, so per part (source) 31 counts
say everything.  The removal polynomial of a part has one coefficient for each
set of filters: at a corner (filters on or off) it is the number of documents
that those filters remove, and the integral of its partial derivative along
the diagonal is a filter's Shapley value.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.arrow import frugal

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITALS_PERCENT = 5
SYMBOLS = "[#$%&*|]"
_BLANKS = r"[\x20\x09-\x0D]+"


def failed(text: Column) -> Column:
    """Bits 0 to 3: which of the filters A to D the text (null: empty) fails, each judged by itself."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, _BLANKS), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bits = (
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words),
        100 * capitals > MOST_CAPITALS_PERCENT * F.length(text),
        text.rlike(SYMBOLS),
    )
    return sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits[1:], 1)), F.when(bits[0], 1).otherwise(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each source by the set of filters they fail.

    Filter E (a smaller doc_id has the identical text) is decided per group of
    equal texts by SHA-256: all but the rows of the smallest id fail.  Equal
    texts are pre-aggregated with their part and labels before they move, so a
    group of copies sends one row per task and part.
    """
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), failed(F.col("text")).alias("mask"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha")
    )
    rows = rows.groupBy("id", "part", "mask", "sha").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, "id", "left").withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    copies = rows.groupBy("sha", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least")
    )
    first = F.min("least").over(Window.partitionBy("sha"))
    copies = copies.withColumn("kept_e", F.col("no_id") + F.when(F.col("least") == first, F.col("n_least")).otherwise(0))
    sides = F.array(
        F.struct(F.col("mask"), F.col("kept_e").alias("m")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("kept_e")).alias("m")),
    )
    each = copies.select("part", "good", "toxic", F.explode(sides).alias("side")).where("side.m > 0")
    m = F.col("side.m")
    return each.groupBy("part", F.col("side.mask").alias("mask")).agg(F.sum(m).alias("n"), F.sum(m * F.col("good")).alias("good"), F.sum(m * F.col("toxic")).alias("toxic"))


def removal_polynomial(counts: list[int]) -> list[int]:
    """Coefficients by set of filters of the polynomial whose corners count removed documents, from counts by mask.

    A mask's documents are removed unless all its filters are off:
    1 - prod(1 - x_i).  Multiplied out, a set T gets (-1)^(|T| + 1) times the
    documents whose mask contains T.
    """
    out = [0] * len(counts)
    for chosen in range(1, len(counts)):
        containing = sum(n for mask, n in enumerate(counts) if mask & chosen == chosen)
        out[chosen] = containing if chosen.bit_count() % 2 else -containing
    return out


def corner(polynomial: list[int], chosen: int) -> int:
    """Documents that the filters of ``chosen`` remove: the polynomial where they are one and the others zero."""
    return sum(c for t, c in enumerate(polynomial) if t & chosen == t)


def shapley(polynomial: list[int], filters: int) -> list[int]:
    """Each filter's removals summed over all orders: the exact integral of its partial derivative along the diagonal, times filters!."""
    out = []
    for i in range(filters):
        integral = sum((Fraction(c, t.bit_count()) for t, c in enumerate(polynomial) if t >> i & 1), Fraction(0))
        scaled = integral * factorial(filters)
        if scaled.denominator != 1:
            raise ArithmeticError("a sum over orders must be whole")
        out.append(int(scaled))
    return out


def _orders() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names of all orders; for each order and step the filter, the filters before it, and those up to it."""
    orders = list(permutations(range(len(FILTERS))))
    at = np.array(orders)
    upto = np.cumsum(1 << at, axis=1)
    return ["".join(FILTERS[k] for k in order) for order in orders], at, upto - (1 << at), upto


def expand(counts: DataFrame) -> DataFrame:
    """The 600 rows (order, step) of each part from one row of mask counts each: part, n, good, toxic (arrays by mask)."""
    names, at, before, upto = _orders()
    steps = len(FILTERS)
    kinds = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def run(batches):
        for batch in batches:
            for part, *columns in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "good", "toxic"))):
                polynomials = [removal_polynomial(c) for c in columns]
                gone, good, toxic = (np.array([corner(p, s) for s in range(MASKS)], np.int64) for p in polynomials)
                fails = np.array([polynomials[0][1 << k] for k in range(steps)], np.int64)
                alone = np.array([columns[0][1 << k] for k in range(steps)], np.int64)
                worth = np.array(shapley(polynomials[0], steps), np.int64)
                removed = gone[upto] - gone[before]
                values = (sum(columns[0]) - gone[upto], removed, fails[at] - removed, alone[at], good[upto] - good[before], toxic[upto] - toxic[before], worth[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * removed.size), pa.array(np.repeat(names, steps).tolist()), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names))), *(pa.array(v.reshape(-1)) for v in values)],
                    ["part", "filter_order", "step", *kinds],
                )

    return counts.select("part", "n", "good", "toxic").mapInArrow(frugal(run), "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in kinds))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` has doc_id, text, source; ``labels`` has doc_id, quality, toxic.
    A null text is empty, a null source is the part '', a null doc_id is a row
    that has no label, is never a copy and makes none.  Rows that repeat an id
    all count, and none of them is a copy of another; repeated labels of an id
    count once, as 1 where any of them is 1.  Texts of any length are read
    whole; an empty table gives an empty result; other columns are not read.
    """
    counts = mask_counts(docs, labels)
    by_mask = [F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for k in range(MASKS)]).alias(c) for c in ("n", "good", "toxic")]
    return expand(counts.groupBy("part").agg(*by_mask))
