"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from quirebook.llm import bpe, chat, clusters, decontam, langid, lm, negatives, pii, quality, secrets, simhash, toxicity, urlfilter

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_decontam": decontam.query,
    "decontam_near": decontam.near_query,
    "op3_secrets": secrets.query,
    "op4_langid": langid.query,
    "op5_lm": lm.query,
    "op6_quality": quality.query,
    "op7_chat": chat.query,
    "op8_simhash": simhash.query,
    "op9_urlfilter": urlfilter.query,
    "op10_pii": pii.query,
    "op11_toxicity": toxicity.query,
    "op12_clusters": clusters.query,
    "op13_negatives": negatives.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontam": decontam.SQL,
    "op6_quality": quality.SQL,
    "op7_chat": chat.SQL,
    "op12_clusters": clusters.SQL,
    "op13_negatives": negatives.SQL,
}
