"""The subpackage's queries and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from almanac.llm import changes, decontaminate, language, lexical, mixing, nearjoin, privacy, quality, repeats, simhash, tokens, topk, toxicity

QUERIES = {
    "op1_tokens": tokens.op1_tokens,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_repeats": repeats.op4_repeats,
    "op5_mix": mixing.op5_mix,
    "op6_quality": quality.op6_quality,
    "op7_language": language.op7_language,
    "op8_topk": topk.op8_topk,
    "op9_pii": privacy.op9_pii,
    "op10_near_duplicates": nearjoin.op10_near_duplicates,
    "op11_search": lexical.op11_search,
    "op12_simhash": simhash.op12_simhash,
    "op13_changes": changes.op13_changes,
}

ORACLE_SQL = {"op5_mix": mixing.OP5_SQL, "op8_topk": topk.OP8_SQL, "op11_search": lexical.OP11_SQL}
