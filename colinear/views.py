"""Views that shape the harness tables like the domain's. One SQL text for Spark and DuckDB; `align_scores` and `reference` filter by a modulo."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.operators import chains
from colinear.session import table

VIEWS = {
    "acr_motif": """
SELECT concat('Chr', cast(user_id % 5 + 1 AS string), '_', cast(user_id * 1000 + 1 AS string), 'to',
              cast(user_id * 1000 + 400 + (user_id % 7) * 100 AS string),
              CASE WHEN user_id % 10 IN (3, 7) THEN '_rand' ELSE '' END) AS acr,
       cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS int) AS pos,
       concat(event_type, '-', cast(event_id % 64 AS string)) AS motif
FROM events""",
    "fimo": """
SELECT concat('M', cast(l_partkey % 200 AS string)) AS motif, concat('Chr', cast(l_suppkey % 5 + 1 AS string)) AS chrom,
       cast(l_orderkey * 5 + l_linenumber AS int) AS start_pos,
       cast(l_orderkey * 5 + l_linenumber + 5 + cast(l_quantity AS int) % 12 AS int) AS stop_pos
FROM lineitem""",
    "regions": """
SELECT concat('Chr', cast(o_custkey % 5 + 1 AS string), '_', cast(o_orderkey * 5 + 1 AS string), 'to',
              cast(o_orderkey * 5 + 21 + o_custkey % 60 AS string)) AS acr,
       concat('Chr', cast(o_custkey % 5 + 1 AS string)) AS chrom,
       cast(o_orderkey * 5 + 1 AS int) AS start_pos, cast(o_orderkey * 5 + 21 + o_custkey % 60 AS int) AS stop_pos
FROM orders""",
    "hits": """
SELECT l_suppkey AS q, cast(floor(l_extendedprice / 1000) AS int) AS score, concat('Chr', cast(l_suppkey % 5 + 1 AS string)) AS chrom,
       cast(l_orderkey * 5 AS int) AS start_pos, cast(l_orderkey * 5 + 40 + cast(l_quantity AS int) AS int) AS stop_pos,
       round(l_discount * 20 - 1, 4) AS align_score
FROM lineitem
UNION ALL
SELECT l_suppkey, cast(floor(l_extendedprice / 1000) AS int), concat('Chr', cast(l_suppkey % 5 + 1 AS string)),
       cast(l_orderkey * 5 AS int), cast(l_orderkey * 5 + 40 + cast(l_quantity AS int) AS int), round(l_discount * 20 - 1, 4)
FROM lineitem WHERE l_returnflag = 'A'""",
    "genes": """
SELECT concat('AT', cast(c_custkey AS string)) AS gene, concat('Chr', cast(c_custkey % 5 + 1 AS string)) AS chrom,
       CASE WHEN c_nationkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
       cast(c_custkey * 50 + 1 AS int) AS start_pos, cast(c_custkey * 50 + 31 + c_nationkey AS int) AS stop_pos
FROM customer""",
    "expression": """
SELECT concat('AT', cast(l_partkey % 30 AS string)) AS gene, l_returnflag AS experiment, cast(l_linenumber AS int) AS cond,
       sum(cast(round(l_extendedprice * 100) AS bigint)) / count(*) / 100 AS tpm
FROM lineitem GROUP BY 1, 2, 3""",
    "acrs": """
SELECT DISTINCT user_id, concat('Chr', cast(user_id % 5 + 1 AS string), '_', cast(user_id * 1000 + 1 AS string), 'to',
              cast(user_id * 1000 + 400 + (user_id % 7) * 100 AS string),
              CASE WHEN user_id % 10 IN (3, 7) THEN '_rand' ELSE '' END) AS acr
FROM events""",
    "align_scores": """
SELECT x.acr AS r1, y.acr AS r2, cast((x.user_id * 7 + y.user_id * 13) % 101 AS double) AS align_score
FROM acrs x JOIN acrs y ON x.user_id % 5 = y.user_id % 5 AND x.acr < y.acr
WHERE (x.user_id + y.user_id * 3) % 10 <> 0""",
    "motif_scores": """
SELECT motif, cast(1 + count(*) % 7 AS double) + count(DISTINCT acr) / cast(8 AS double) AS score FROM acr_motif GROUP BY motif""",
    "reference": """
SELECT acr AS region FROM acrs WHERE acr NOT LIKE '%_rand' AND user_id % 2 = 0""",
    "pair_lengths": """
SELECT least(x.acr, y.acr) AS r1, greatest(x.acr, y.acr) AS r2, cast(count(*) AS double) AS score, count(*) AS n_anchors
FROM (SELECT acr, motif, count(*) AS n FROM acr_motif GROUP BY 1, 2) x JOIN (SELECT acr, motif, count(*) AS n FROM acr_motif GROUP BY 1, 2) y
  ON x.motif = y.motif AND x.acr < y.acr GROUP BY 1, 2""",
    "sequences": """
SELECT s_suppkey AS id, translate(concat(md5(s_name), md5(concat('x', s_name))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM supplier""",
    "query_sequences": """
SELECT n_nationkey AS id, translate(md5(n_name), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM nation""",
}
TABLES = ("events", "lineitem", "orders", "customer", "supplier", "nation", "embeddings")


def _needs(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def sql(body: str) -> str:
    """body with the views that it uses, for DuckDB."""
    names: list[str] = []

    def visit(text: str) -> None:
        for v in _needs(text):
            if v not in names:
                visit(VIEWS[v])
                if v not in names:
                    names.append(v)

    visit(body)
    recursive = "RECURSIVE " if re.match(r"\s*WITH\s+RECURSIVE\b", body, re.I) else ""
    rest = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I) if re.match(r"\s*WITH\b", body, re.I) else None
    head = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in names)
    return f"WITH {recursive}{head}{', ' if rest else ''}\n{rest or body}" if head else body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame. Pairs of regions are counted by blocks, where the text would shuffle a row for each motif of each pair."""
    if name == "pair_lengths":
        n = F.col("n_motifs")
        return chains.motif_counts(view(spark, sf_dir, "acr_motif")).select(F.col("acr1").alias("r1"), F.col("acr2").alias("r2"), n.cast("double").alias("score"), n.alias("n_anchors"))
    text = VIEWS[name]
    frames = {}
    for t in TABLES:
        if re.search(rf"\bFROM {t}\b", text):
            frames[t] = table(spark, sf_dir, t)
    for v in _needs(text):
        frames[v] = view(spark, sf_dir, v)
    for n in frames:
        text = re.sub(rf"\b{n}\b(?=\s|\)|$)", "{" + n + "}", text)
    return spark.sql(text, **frames)
