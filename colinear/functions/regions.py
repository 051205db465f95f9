"""Region identifiers `<chrom>_<start>to<stop>[_rand][_rev]` as columns. Coordinates are 1-based and inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the grammar of a region identifier.
PATTERN = r"^(.+?)_(\d+)to(\d+)(_rand)?(_rev)?$"


def _part(region: Column, k: int) -> Column:
    return F.regexp_extract(region, PATTERN, k)


def chrom(region: Column) -> Column:
    return F.nullif(_part(region, 1), F.lit(""))


def endpoints(region: Column) -> tuple[Column, Column]:
    """(start, stop) in ascending order, whichever way the identifier has them; null if it isn't one."""
    a, b = (F.nullif(_part(region, k), F.lit("")).cast("int") for k in (2, 3))
    return F.least(a, b), F.greatest(a, b)


def is_random(region: Column) -> Column:
    return _part(region, 4) == "_rand"


def is_reversed(region: Column) -> Column:
    return _part(region, 5) == "_rev"


def parse_regions(df: DataFrame, column: str = "acr") -> DataFrame:
    """Adds chrom, start_pos, stop_pos, is_rand, is_rev and length."""
    lo, hi = endpoints(F.col(column))
    return df.withColumns({"chrom": chrom(F.col(column)), "start_pos": lo, "stop_pos": hi, "is_rand": is_random(F.col(column)), "is_rev": is_reversed(F.col(column)), "length": length(lo, hi)})


def region_id(chrom: Column, start: Column, stop: Column, rand: Column | None = None, rev: Column | None = None) -> Column:
    tail = [F.when(x, F.lit(s)).otherwise("") for x, s in ((rand, "_rand"), (rev, "_rev")) if x is not None]
    return F.concat(chrom, F.lit("_"), start.cast("string"), F.lit("to"), stop.cast("string"), *tail)


def length(start: Column, stop: Column) -> Column:
    return F.abs(stop - start) + 1


def overlap_size(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """End minus start of the common part, without the one that closed intervals would add."""
    return F.least(a_stop, b_stop) - F.greatest(a_start, b_start)


def canonical(a: Column, b: Column) -> tuple[Column, Column]:
    """The pair with the smaller identifier first."""
    return F.least(a, b), F.greatest(a, b)
