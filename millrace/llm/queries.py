"""The queries of this package by name, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from millrace.llm import embedding_dups, filter_audit, lexical
from millrace.llm.decontaminate import op1_decontaminate
from millrace.llm.html_text import op8_html_text
from millrace.llm.mixing import op4_mix_sources
from millrace.llm.near_dups import op3_minhash_near_dedup
from millrace.llm.pii import op7_pii
from millrace.llm.quality import op9_quality
from millrace.llm.sharding import op12_virtual_slots
from millrace.llm.substrings import op6_substring_dedup
from millrace.llm.token_counts import op2_token_counts
from millrace.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_embedding_near_dedup": embedding_dups.op5_embedding_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_pii": op7_pii,
    "op8_html_text": op8_html_text,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_virtual_slots": op12_virtual_slots,
    "op13_lexical_search": lexical.op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op5_embedding_near_dedup": embedding_dups.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_lexical_search": lexical.SQL,
}
