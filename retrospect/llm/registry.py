"""The queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from . import chat, dac, embedding_dedup, exact_dedup, langid, line_dedup, packing, pieces, simhash, url_filter

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_langid": langid.op2_langid,
    "op3_token_ids": dac.op3_token_ids,
    "op4_chat": chat.op4_chat,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_simhash": simhash.op7_simhash,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_sentencepiece": pieces.op10_sentencepiece,
}
SQL = {
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
}
