"""Rows in order, cut into runs of bounded size.

An ordered fold over many rows is done run by run and then over the runs. Runs are ranges of (key,
order) with about as many rows each, so neither a dominating key nor a burst within one hour makes a
run larger than another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.session import store

#: Rows of a run.
ROWS = 100_000


def runs(df: DataFrame, order: list[str], key: list[str] = (), rows: int | None = None) -> DataFrame:
    """df with `_b`, the number of the row's run, which never falls along (key, order). It is stored, as the
    ranges are drawn from a sample and all readers must see the same ones. Nulls come first."""
    n = max(1, -(-df.count() // (rows or ROWS)))
    return store(df.repartitionByRange(n, *key, *order).withColumn("_b", F.spark_partition_id()))
