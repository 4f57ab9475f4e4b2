"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, conversation_repair, fingerprints, jaccard_join, licenses, mixing, packing, quality, spelling, token_counts, toxicity, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_pack_sequences": packing.op3_pack_sequences,
    "op4_chat_format": chat.op4_chat_format,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_warc_round_trip": warc.op9_warc_round_trip,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_bpe_round_trip": bpe.op12_bpe_round_trip,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op9_warc_round_trip": warc.ORACLE,
}
