"""Registered corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import class_lm, collocations, fingerprints, mixing, ngram_join, packing, prefix_trie, search, sharding, tokens, toxicity, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_token_counts": tokens.op2_token_counts,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_packing": packing.op4_packing,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_topk_search": search.op6_topk_search,
        "op7_token_files": tokens.op7_token_files,
        "op8_class_lm": class_lm.op8_class_lm,
        "op9_mixing": mixing.op9_mixing,
        "op10_sharding": sharding.op10_sharding,
        "op11_collocations": collocations.op11_collocations,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_url_filters": url_filters.op13_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_join": ngram_join.SQL, "op6_topk_search": search.SQL, "op11_collocations": collocations.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_url_filters": url_filters.SQL}
