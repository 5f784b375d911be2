"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from epiwatch.llm.ann_search import op10_ann_search
from epiwatch.llm.line_dedup import op7_line_dedup
from epiwatch.llm.merkle import op11_merkle_manifest
from epiwatch.llm.ngram_join import op13_ngram_join
from epiwatch.llm.ngram_model import op8_lm_scoring
from epiwatch.llm.packing import op5_packing
from epiwatch.llm.piece_codec import op9_piece_codec
from epiwatch.llm.quality_rules import op3_quality_rules
from epiwatch.llm.secret_scan import op1_secret_scan
from epiwatch.llm.simhash_dedup import op4_simhash_dedup
from epiwatch.llm.substring_dedup import op6_substring_dedup
from epiwatch.llm.token_alignment import op12_token_alignment
from epiwatch.llm.token_counts import op2_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_packing": op5_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_piece_codec": op9_piece_codec,
    "op10_ann_search": op10_ann_search,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_alignment": op12_token_alignment,
    "op13_ngram_join": op13_ngram_join,
}

#: None of the operators can be said in SQL over whole tables; tests/llm holds
#: each against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
