"""The queries and SQL of this subpackage, for the registry at the top of the repository."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard, language, licenses, neighbours, packing, secrets, suffix_tree, token_files, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.op1,
    "op2_topk_search": topk.op2,
    "op3_license_scan": licenses.op3,
    "op4_language_id": language.op4,
    "op5_embedding_near_dedup": neighbours.op5,
    "op6_ngram_jaccard_join": jaccard.op6,
    "op7_token_files": token_files.op7,
    "op8_best_fit_packing": packing.op8,
    "op9_lm_scoring": suffix_tree.op9,
    "op10_bpe_round_trip": bpe.op10,
}
ORACLES: dict[str, str] = {
    "op2_topk_search": topk.ORACLE,
    "op3_license_scan": licenses.oracle(),
    "op5_embedding_near_dedup": neighbours.ORACLE,
    "op6_ngram_jaccard_join": jaccard.ORACLE,
}
