"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from lexigrid.llm import embedding_dedup, jaccard_join, language_model, mixing, packing, pii, secrets, suffix_dedup, topk_search, toxicity

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_packing": packing.op3_packing,
    "op4_pii": pii.op4_pii,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_topk_search": topk_search.op6_topk_search,
    "op7_language_model": language_model.op7_language_model,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_mixing": mixing.op9_mixing,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
}
SQL = {
    "op5_suffix_dedup": suffix_dedup.OP5_SQL,
    "op6_topk_search": topk_search.OP6_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_embedding_dedup": embedding_dedup.OP10_SQL,
}
