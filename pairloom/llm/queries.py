"""The registered queries of this subpackage."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, embeddings, jaccard, language_model, mixing, quality, secrets, tokens, toxicity, urls


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1,
        "op2_secrets": secrets.op2,
        "op3_embeddings": embeddings.op3,
        "op4_decontamination": decontaminate.op4,
        "op5_quality": quality.op5,
        "op6_toxicity": toxicity.op6,
        "op7_jaccard": jaccard.op7,
        "op8_tokens": tokens.op8,
        "op9_urls": urls.op9,
        "op10_language_model": language_model.op10,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op2_secrets": secrets.ORACLE, "op3_embeddings": embeddings.ORACLE, "op7_jaccard": jaccard.ORACLE}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
