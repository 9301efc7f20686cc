"""Samples that depend on the rows alone: the same from any layout and on any engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str], seed: int) -> Column:
    """A keyed hash of the columns' texts; null is told from empty."""
    spelled = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *spelled))


def bottom_k(df: DataFrame, stratum: str, key: Sequence[str], k: int, seed: int = 42, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows of each stratum with the least hashes of ``key``, with the hash as ``_hash``.

    Each partition keeps its own ``k`` per stratum before any row is moved, so
    a stratum with most of the rows costs no more than the others. Rows of
    equal hash go by ``ties``; rows equal in those are alike.
    """
    hashed = df.withColumn("_hash", row_hash(key, seed))
    order = Window.partitionBy(stratum).orderBy("_hash", *ties)
    return hashed.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")
