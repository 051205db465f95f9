"""Splits and samples that depend on a seed and the rows' keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colinear.functions.regions import region_id


def keyed_order(key: Column, seed: int) -> Column:
    """A text that orders keys as if at random, the same in every engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"/{seed}")))


def ranked(df: DataFrame, order: list[Column], name: str = "rank", amount: Column | None = None, parts: int = 256) -> DataFrame:
    """Adds the 1-based place in order, or the running sum of amount: within ranges of the order, and what lies before each range."""
    amount = F.lit(1) if amount is None else amount
    keyed = df.withColumn("_o", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    placed = keyed.repartitionByRange(parts, "_o").withColumn("_p", F.spark_partition_id())
    local = placed.withColumn("_a", amount).withColumn("_r", F.sum("_a").over(Window.partitionBy("_p").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)))
    from colinear.session import stored

    local = stored(local)
    before = local.groupBy("_p").agg(F.sum("_a").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(F.broadcast(before), "_p").withColumn(name, F.col("_r") + F.col("_b")).drop("_p", "_r", "_b", "_o", "_a")  # a row a part


def split_fraction(df: DataFrame, key: str, fraction: float, seed: int | None = None) -> DataFrame:
    """Adds in_first: the first floor(n * fraction) rows in order of key (seed None: as published), or of its keyed hash."""
    order = [F.col(key)] if seed is None else [keyed_order(F.col(key), seed), F.col(key)]
    n = df.count()
    return ranked(df, order).withColumn("in_first", F.col("rank") <= int(n * fraction)).drop("rank")


def sample_per_group(df: DataFrame, sizes: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """For each group of sizes (group, k) k keys of df, without replacement, by the keyed hash of group and key.

    A group takes the k lowest hashes. Only rows below a hash bound that holds at least twice k on average are ranked
    first; groups that come up short rank all rows.
    """
    n = max(1, df.count())
    h = F.conv(F.substring(keyed_order(F.concat(F.col(group).cast("string"), F.lit("/"), F.col(key).cast("string")), seed), 1, 8), 16, 10).cast("long")
    cases = df.select(key).crossJoin(F.broadcast(sizes.select(group, "k"))).withColumn("_h", h)  # a small table of groups
    near = cases.where(F.col("_h") / 2.0**32 <= F.least(F.lit(1.0), (2.0 * F.col("k") + 32) / n))
    first = _lowest(near, group, key)
    got = first.groupBy(group).agg(F.count("*").alias("_got"))
    short = sizes.join(got, group, "left").where(F.coalesce("_got", F.lit(0)) < F.least(F.col("k"), F.lit(n))).select(group)
    whole = _lowest(cases.join(short, group, "left_semi"), group, key)
    return first.join(short, group, "left_anti").select(group, key).union(whole.select(group, key))


def _lowest(rows: DataFrame, group: str, key: str, bits: int = 16) -> DataFrame:
    """The k rows of the lowest (_h, key) of each group, _h having 32 bits: within stretches of hashes, and what lies before each, so a group that
    takes most rows is no one task's."""
    dealt = rows.withColumn("_s", F.shiftright("_h", bits))
    per = dealt.groupBy(group, "_s").agg(F.count("*").alias("_n"))
    before = per.select(F.col(group).alias("_g"), F.col("_s").alias("_t"), F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # at most 2^(32 - bits) rows a group
    met = dealt.join(before, dealt[group].eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_t"))).where("_before < k")
    place = F.row_number().over(Window.partitionBy(group, "_s").orderBy("_h", key)) + F.col("_before")
    return met.withColumn("_r", place).where(F.col("_r") <= F.col("k"))


def random_regions(spark, lengths: DataFrame, n: int, low: int, high: int, seed: int) -> DataFrame:
    """(acr, chrom, start_pos, stop_pos): n random regions of low to high bases, on chromosomes (chrom, length, rank from 0)."""
    return matched_regions(spark.range(n).select("id", (F.lit(low) + F.pmod(F.xxhash64("id", F.lit(f"size{seed}")), F.lit(high - low + 1))).cast("int").alias("size")), lengths, seed)


def matched_regions(sizes: DataFrame, lengths: DataFrame, seed: int) -> DataFrame:
    """A random region for each (id, size), by the keyed hash of the id; the same chromosome and start for the same id and seed."""
    k = lengths.count()
    number = lambda what: F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"/{what}{seed}"))), 1, 12), 16, 10).cast("long")
    pick = lambda what, upto: F.pmod(number(what), upto)
    placed = sizes.withColumn("rank", pick("chrom", F.lit(k)).cast("int")).join(lengths, "rank").where(F.col("length") >= F.col("size"))
    start = (pick("start", F.col("length") - F.col("size") + 1) + 1).cast("int")
    stop = (start + F.col("size") - 1).cast("int")
    return placed.select(region_id(F.col("chrom"), start, stop, F.lit(True)).alias("acr"), "chrom", start.alias("start_pos"), stop.alias("stop_pos"))
