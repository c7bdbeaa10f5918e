"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from terrafuse.llm import chat, quality, urls
from terrafuse.llm.chat import op4_perspectives
from terrafuse.llm.langid import op5_language_id
from terrafuse.llm.mixing import op2_mix_sources
from terrafuse.llm.neighbours import op8_nearest
from terrafuse.llm.packing import op3_pack_documents
from terrafuse.llm.quality import op6_host_quality
from terrafuse.llm.secrets import op7_secret_scan
from terrafuse.llm.simhash import op1_simhash_dedup
from terrafuse.llm.tokencount import op9_token_counts
from terrafuse.llm.urls import op10_url_filter

QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_pack_documents": op3_pack_documents,
    "op4_perspectives": op4_perspectives,
    "op5_language_id": op5_language_id,
    "op6_host_quality": op6_host_quality,
    "op7_secret_scan": op7_secret_scan,
    "op8_nearest": op8_nearest,
    "op9_token_counts": op9_token_counts,
    "op10_url_filter": op10_url_filter,
}
ORACLE: dict[str, str] = {
    "op4_perspectives": chat.ORACLE_SQL,
    "op6_host_quality": quality.ORACLE_SQL,
    "op10_url_filter": urls.ORACLE_SQL,
}
