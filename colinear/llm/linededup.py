"""Cross-site boilerplate lines by their spread over distinct sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.session import stored, table

#: A line on this many distinct sites or more is boilerplate.
SITES = 5
#: HyperLogLog registers as a power of two; its standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Estimates this share of SITES off, or one site, get an exact count.
NEAR = 0.1
#: Line hashes are sent to every task up to this many.
SENT = 1_000_000
_BLANKS = " \t\r\x0b\x0c"


def _lines(docs: DataFrame) -> DataFrame:
    """(row_key, site, pos, h): every line with a word."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row_key")
    line = F.btrim("line", F.lit(_BLANKS))
    return docs.select(key, F.col("source").cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("row_key", "site", "pos", line.alias("line")).where("line <> ''").select("row_key", "site", "pos", F.xxhash64("line").alias("h"))


def spread_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(h): hashes of the lines on `sites` distinct sites or more; a null source is no site.

    One HyperLogLog sketch per line hash, merged by the aggregation's partial step, so that a line on a third of all
    rows leaves each task as one sketch. Estimates near `sites` are replaced by exact counts of distinct sites.
    """
    lines = _lines(docs).select("h", "site").where("site is not null")
    off = max(1.0, NEAR * sites)
    estimate = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("n"))
    estimate = stored(estimate.where(F.col("n") >= sites - off))
    near = _small(estimate.where(F.col("n") <= sites + off).select("h"))
    exact = lines.join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("h")
    return stored(estimate.where(F.col("n") > sites + off).select("h").union(exact))


def _small(hashes: DataFrame) -> DataFrame:
    """Marked for broadcast if it has SENT rows of 8 bytes at most; else adaptive execution splits what is skewed."""
    return F.broadcast(hashes) if hashes.count() <= SENT else hashes


def without_boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """The columns of docs with boilerplate lines taken out of text, n_chars (if there) to match, and n_lines, n_removed.

    A document that would be left without a word is a copy rather than a page with boilerplate: it stays as it is, for
    near-duplicate removal. Null and empty texts stay, with no lines removed. Repeated rows each stay. Lines are equal
    if they are without the blanks around them; lines without a word are kept.
    """
    hits = _lines(docs).join(_small(spread_lines(docs, sites)), "h", "left_semi").groupBy("row_key").agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"))  # so that no name clashes
    joined = rows.join(hits, F.xxhash64(F.col("r.doc_id").cast("long"), F.col("r.text")) == hits["row_key"], "left").select("r", "gone", F.split("r.text", "\n").alias("lines"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")  # by a hash set: linear in a document's lines
    left = F.array_join(F.transform(stays, lambda i: F.get("lines", i)), "\n")
    joined = joined.select("r", "gone", "lines", F.when(F.col("gone").isNull(), F.col("r.text")).otherwise(left).alias("left"))
    copy = F.col("gone").isNotNull() & ~F.col("left").rlike("[^ \\t\\r\\n\\x0B\\x0C]")
    removed = F.when(F.col("gone").isNull() | copy, 0).otherwise(F.size("gone"))
    text = F.when(copy, F.col("r.text")).otherwise(F.col("left"))
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    return joined.select(
        *[own.get(c, F.col("r").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def line_sql(source: str, sites: int = SITES) -> str:
    r"""CTEs that end in `deduped` (the columns of source and n_lines, n_removed), for DuckDB."""
    return rf"""
numbered AS (SELECT *, row_number() OVER () AS _row FROM {source}),
split_lines AS (SELECT _row, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM numbered),
trimmed AS (SELECT _row, source, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM split_lines),
boiler AS (SELECT t FROM trimmed WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {sites}),
rebuilt AS (SELECT _row, count(*) AS n_lines, count(*) FILTER (t IN (SELECT t FROM boiler)) AS n_gone, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (t NOT IN (SELECT t FROM boiler)), '') AS kept FROM trimmed GROUP BY _row),
deduped AS (SELECT n.* EXCLUDE (_row, text), CASE WHEN r.n_gone > 0 AND NOT copied THEN kept ELSE text END AS text,
  coalesce(n_lines, 0)::BIGINT AS n_lines, (CASE WHEN copied THEN 0 ELSE coalesce(n_gone, 0) END)::BIGINT AS n_removed FROM numbered n LEFT JOIN (SELECT *, NOT regexp_matches(kept, '[^ \t\r\n\x0B\x0C]') AS copied FROM rebuilt) r USING (_row))"""


OP2_SQL = f"WITH {line_sql('documents').strip()}\nSELECT doc_id, text, n_lines, n_removed FROM deduped"
