"""One-row tables as extra columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, one: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``one``, a global aggregate: one row by construction, so it is broadcast."""
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")
