"""The queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, embed_dedup, jaccard_join, licenses, line_dedup, lm_score, mixing, packing, quality, resample, sharding, token_store
from .common import scratch



def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that writes its result and deletes all other tables it wrote."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch() as keep:
            return keep(query(spark, sf_dir), "result")

    return run


#: Operators 7 and 11 to 13 delete their tables themselves, 10 writes none.
QUERIES = {
    "op1_decontamination": tidy(decontaminate.query),
    "op2_jaccard_join": tidy(jaccard_join.query),
    "op3_token_store": token_store.query,
    "op4_lm_score": tidy(lm_score.query),
    "op5_sharding": tidy(sharding.query),
    "op6_packing": tidy(packing.query),
    "op7_embedding_dedup": embed_dedup.query,
    "op8_quality": tidy(quality.query),
    "op9_line_dedup": tidy(line_dedup.query),
    "op10_license_scan": licenses.query,
    "op11_mixing": mixing.query,
    "op12_conversation_trie": conversations.query,
    "op13_importance_resample": resample.query,
}

ORACLE_SQL = {"op10_license_scan": licenses.ORACLE_SQL, "op12_conversation_trie": conversations.ORACLE_SQL, "op13_importance_resample": resample.ORACLE_SQL}
