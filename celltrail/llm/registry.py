"""The ten queries and their SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, line_dedup, near_dedup, quality, sharding, token_store, topk, url_filter

QUERIES = {
    "op1_topk": topk.op1_topk, "op2_bpe": bpe.op2_bpe, "op3_sharding": sharding.op3_sharding,
    "op4_decontaminate": decontaminate.op4_decontaminate, "op5_quality": quality.op5_quality, "op6_token_store": token_store.op6_token_store,
    "op7_line_dedup": line_dedup.op7_line_dedup, "op8_url_filter": url_filter.op8_url_filter, "op9_chat_format": chat.op9_chat_format,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}
SQL = {
    "op1_topk": topk.SQL, "op3_sharding": sharding.SQL, "op4_decontaminate": decontaminate.SQL, "op7_line_dedup": line_dedup.SQL, "op8_url_filter": url_filter.SQL, "op10_near_dedup": near_dedup.SQL,
}
