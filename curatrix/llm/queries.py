"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from curatrix.llm import bpe, chat, fim, mixing, quality_model, rules, runs, sharding, simhash, tokens, toxicity, urls, vectors


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_token_files": tokens.op2_token_files,
        "op3_simhash": simhash.op3_simhash,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_sharding": sharding.op5_sharding,
        "op6_quality": quality_model.op6_quality,
        "op7_bpe": bpe.op7_bpe,
        "op8_rules": rules.op8_rules,
        "op9_vectors": vectors.op9_vectors,
        "op10_urls": urls.op10_urls,
        "op11_fim": fim.op11_fim,
        "op12_chats": chat.op12_chats,
        "op13_runs": runs.op13_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.OP1_SQL, "op5_sharding": sharding.OP5_SQL, "op9_vectors": vectors.OP9_SQL, "op10_urls": urls.OP10_SQL, "op11_fim": fim.OP11_SQL, "op12_chats": chat.OP12_SQL}
