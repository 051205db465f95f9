"""Ordered computations along chromosomes by stretches of bases, so that a chromosome is no one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases of a stretch.
STRETCH = 1 << 20


def dealt(df: DataFrame, start: str = "start_pos", size: int = STRETCH) -> DataFrame:
    """Adds _b, the stretch that a row starts in."""
    return df.withColumn("_b", F.floor(F.col(start) / size).cast("long"))


def within(group: str) -> Window:
    """A window over one stretch of one group."""
    return Window.partitionBy(group, "_b")


def carried(df: DataFrame, group: str, totals: dict[str, Column], over: dict[str, Column], backwards: bool = False) -> DataFrame:
    """Adds to each row of df (dealt) what the stretches before it (backwards: after it) come to.

    totals: an aggregate of a stretch for each name; over: what to make of these over the other stretches, as an aggregate of the
    same names. Stretches are one row each, so their window by group is short. Every row stays: rows of a null group are a group,
    and those of a null start a stretch of their own, before the others.
    """
    per = df.groupBy(group, "_b").agg(*[c.alias(f"_t_{k}") for k, c in totals.items()])
    order = Window.partitionBy(group).orderBy(F.desc("_b") if backwards else "_b").rowsBetween(Window.unboundedPreceding, -1)
    found = per.select(F.col(group).alias("_g"), F.col("_b").alias("_s"), *[c.over(order).alias(k) for k, c in over.items()])
    return df.join(found, df[group].eqNullSafe(F.col("_g")) & df["_b"].eqNullSafe(F.col("_s"))).drop("_g", "_s")
