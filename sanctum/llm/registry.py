"""Queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from . import chat, html, mixing, packing, quality, secrets, simhash, tokens, topk, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_html": html.op2_html,
    "op3_secrets": secrets.op3_secrets,
    "op4_mixing": mixing.op4_mixing,
    "op5_tokens": tokens.op5_tokens,
    "op6_packing": packing.op6_packing,
    "op7_warc": warc.op7_warc,
    "op8_topk": topk.op8_topk,
    "op9_chat": chat.op9_chat,
    "op10_quality": quality.op10_quality,
}
SQL = {"op7_warc": warc.SQL, "op8_topk": topk.SQL, "op9_chat": chat.SQL, "op10_quality": quality.SQL}
