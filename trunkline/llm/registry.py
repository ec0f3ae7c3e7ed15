"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from trunkline.llm import chat_format, decontaminate, jaccard_join, poisson_mix, quality_gam, suffix_dedup, toxicity, transport_stream, url_filters, warc

QUERIES = {
    "op1_poisson_mix": poisson_mix.op1_poisson_mix,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_transport_stream": transport_stream.op3_transport_stream,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_warc": warc.op6_warc,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_quality_gam": quality_gam.op9_quality_gam,
    "op10_url_filters": url_filters.op10_url_filters,
}
ORACLE_SQL = {
    "op1_poisson_mix": poisson_mix.ORACLE,
    "op2_chat_format": chat_format.ORACLE,
    "op3_transport_stream": transport_stream.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_suffix_dedup": suffix_dedup.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op10_url_filters": url_filters.ORACLE,
}
