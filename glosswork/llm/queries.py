"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from glosswork.llm import align, ann, bpe, chat, exact_dedup, html_text, langid, lm, packing, periodic, sharding, simhash, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_sum_of_squares_packing": packing.op2_sum_of_squares_packing,
    "op3_html_layout": html_text.op3_html_layout,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_deleted_interpolation": lm.op5_deleted_interpolation,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat_format": chat.op7_chat_format,
    "op8_feistel_sharding": sharding.op8_feistel_sharding,
    "op9_pruned_graph_search": ann.op9_pruned_graph_search,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_event_sweep": align.op11_event_sweep,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_viterbi_language": langid.op13_viterbi_language,
}
ORACLES = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op8_feistel_sharding": sharding.OP8_SQL,
    "op12_periodic_runs": periodic.OP12_SQL,
}
