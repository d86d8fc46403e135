"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog_loom.llm import ann, bpe, centroids, chatfmt, disclosure, jaccard, langid, mixing, periodic, quality, topk, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxic_spans": toxicity.op1,
        "op2_exact_top_k": topk.op2,
        "op3_passage_quality": quality.op3,
        "op4_byte_language": langid.op4,
        "op5_warc_revisits": warc.op5,
        "op6_shingle_jaccard": jaccard.op6,
        "op7_bpe": bpe.op7,
        "op8_entropy_mix": mixing.op8,
        "op9_learned_partitions": ann.op9,
        "op10_preference_chat": chatfmt.op10,
        "op11_centroid_clusters": centroids.op11,
        "op12_periodic_runs": periodic.op12,
        "op13_disclosing_terms": disclosure.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_top_k": topk.SQL, "op6_shingle_jaccard": jaccard.SQL, "op5_warc_revisits": warc.SQL, "op10_preference_chat": chatfmt.SQL, "op11_centroid_clusters": centroids.SQL,
        "op12_periodic_runs": periodic.SQL,
    }
