"""Both jobs as registered queries: each runs twice into a new folder of spark.checkpoint.dir, and returns what stands there then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.queries import REL
from colinear.session import shared_folder
from colinear.views import sql
from jobs import region_motifs, text_reuse


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_region_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "region_motifs")
    for _ in range(2):
        region_motifs.run(spark, sf_dir, out)
    return region_motifs.output(spark, out).select("chrom", "acr", "pos", "motif", "start_pos", "stop_pos", F.round("score", 6).alias("score"), F.round("z_score", 6).alias("z_score"))


JOB1_SQL = sql(f"""
WITH {REL}, own AS (SELECT * FROM (SELECT *, lead(start_pos) OVER (PARTITION BY motif, acr ORDER BY start_pos) - start_pos AS gap FROM inside) WHERE gap IS NULL OR gap > stop_pos - start_pos),
s AS (SELECT motif, log2(p1 / p2) - 0.5 * log2(p2) AS score, CASE WHEN p * (1 - p) = 0 THEN 0 ELSE (p1 - p2) / sqrt(p * (1 - p) * (1 / na + 1 / nf)) END AS z_score FROM z WHERE p1 > 0)
SELECT chrom, acr, cast(dense_rank() OVER (PARTITION BY acr ORDER BY start_pos) - 1 AS int) AS pos, motif, start_pos, stop_pos, round(score, 6) AS score, round(z_score, 6) AS z_score FROM own JOIN s USING (motif)
""".strip())


def job2_text_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "text_reuse")
    for _ in range(2):
        text_reuse.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{out}/rows", f"{out}/checkpoint")
    return text_reuse.output(spark, f"{out}/rows").select("doc_id", "item_id", "lang", "chain", "n_anchors", "n_runs", F.round("share", 6).alias("share"))


def _grams(name: str, table: str, columns: str) -> str:
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    return f"{name} AS MATERIALIZED (SELECT {columns}, text, i AS pos, array_to_string(w[i:i + 3], ' ') AS motif FROM (SELECT {columns}, text, w, unnest(range(1, len(w) - 2)) AS i FROM (SELECT DISTINCT {columns}, text, {words} AS w FROM {table}) WHERE len(w) >= 4))"


JOB2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, nullif(lang, '') AS lang, text FROM documents), {_grams("x", "d", "doc_id, lang")}, {_grams("y", "benchmark", "item_id")},
n AS (SELECT item_id, text, count(*) AS n_runs FROM y GROUP BY ALL),
ids AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, lang, t, item_id, u FROM (SELECT DISTINCT x.doc_id, x.lang, x.text AS t, y.item_id, y.text AS u FROM x JOIN y USING (motif))),
anchors AS MATERIALIZED (SELECT k, x.pos AS a, y.pos AS c FROM x JOIN y USING (motif) JOIN ids ON ids.doc_id IS NOT DISTINCT FROM x.doc_id AND ids.lang IS NOT DISTINCT FROM x.lang AND ids.t = x.text AND ids.item_id IS NOT DISTINCT FROM y.item_id AND ids.u = y.text),
o AS (SELECT k, 1 AS s, a, c FROM anchors UNION SELECT k, -1, a, -c FROM anchors),
r AS (SELECT k, s, a, c, 1 AS l FROM o UNION SELECT n.k, n.s, n.a, n.c, r.l + 1 FROM r JOIN o n ON n.k = r.k AND n.s = r.s AND n.a > r.a AND n.c > r.c),
m AS (SELECT k, max(l) AS chain FROM r GROUP BY 1), q AS (SELECT k, count(*) AS n_anchors FROM anchors GROUP BY 1)
SELECT ids.doc_id, ids.item_id, ids.lang, cast(m.chain AS int) AS chain, q.n_anchors, cast(n.n_runs AS int) AS n_runs, round(m.chain / n.n_runs, 6) AS share
FROM ids JOIN m USING (k) JOIN q USING (k) JOIN n ON n.item_id IS NOT DISTINCT FROM ids.item_id AND n.text = ids.u WHERE m.chain / n.n_runs >= 0.5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_region_motifs, job2_text_reuse)}


def oracle_sql() -> dict[str, str]:
    return {"job1_region_motifs": JOB1_SQL, "job2_text_reuse": JOB2_SQL}
