"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import decontaminate, html_text, language, line_dedup, near_dedup, pack, quality, shard, token_files, vector_dedup

QUERIES = {
    f.__name__: f
    for f in (
        html_text.op1_html_extraction,
        shard.op2_sharding,
        line_dedup.op3_line_dedup,
        near_dedup.op4_minhash_near_dedup,
        vector_dedup.op5_embedding_near_dedup,
        pack.op6_packing,
        quality.op7_quality,
        decontaminate.op8_decontamination,
        language.op9_language_id,
        token_files.op10_token_files,
    )
}

SQL = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_minhash_near_dedup": near_dedup.OP4_SQL,
    "op5_embedding_near_dedup": vector_dedup.OP5_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
}
