"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colinear.llm.centroids import OP11_SQL, op11_centroid_clusters
from colinear.llm.decontaminate import op5_benchmark_decontamination
from colinear.llm.html_text import op1_html_text
from colinear.llm.langid import op8_language_id
from colinear.llm.licenses import op4_license_scan
from colinear.llm.linededup import OP2_SQL, op2_line_dedup
from colinear.llm.ngram_lm import op10_lm_score
from colinear.llm.pieces import op7_sentencepiece
from colinear.llm.quality_model import op6_quality_classifier
from colinear.llm.quality_rules import OP3_SQL, op3_quality_rules
from colinear.llm.secrets import op12_secret_scan
from colinear.llm.simhash import op9_simhash_near_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_html_text,
            op2_line_dedup,
            op3_quality_rules,
            op4_license_scan,
            op5_benchmark_decontamination,
            op6_quality_classifier,
            op7_sentencepiece,
            op8_language_id,
            op9_simhash_near_dedup,
            op10_lm_score,
            op11_centroid_clusters,
            op12_secret_scan,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_quality_rules": OP3_SQL, "op11_centroid_clusters": OP11_SQL}
