"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from tallyweave.llm import chat_format, decontaminate, license_scan, media_sniff, mix_sources, near_dedup, pii_surrogates, shard_compaction, toxicity, url_rules

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_mix_sources": mix_sources.op2_mix_sources,
    "op3_media_sniff": media_sniff.op3_media_sniff,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_url_rules": url_rules.op5_url_rules,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_pii_surrogates": pii_surrogates.op8_pii_surrogates,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_shard_compaction": shard_compaction.op10_shard_compaction,
}
ORACLE_SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_mix_sources": mix_sources.SQL,
    "op4_license_scan": license_scan.SQL,
    "op5_url_rules": url_rules.SQL,
    "op7_chat_format": chat_format.SQL,
    "op9_near_dedup": near_dedup.SQL,
    "op10_shard_compaction": shard_compaction.SQL,
}
