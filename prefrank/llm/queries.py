"""All queries of the subpackage and the SQL of those that SQL can express."""

from prefrank.llm.collocations_queries import OP12_SQL, op12_debruijn
from prefrank.llm.decontamination_queries import op7_block_max_wand
from prefrank.llm.filter_audit_queries import OP13_SQL, op13_retraction_audit
from prefrank.llm.licenses_queries import OP8_SQL, op8_sentence_rules
from prefrank.llm.near_dedup_queries import op4_probminhash
from prefrank.llm.packing_queries import op5_best_fit
from prefrank.llm.piece_encoding_queries import op11_prefix_table
from prefrank.llm.quality_model_queries import op6_boosted_trees
from prefrank.llm.quality_rules_queries import op10_line_first
from prefrank.llm.secrets_queries import op9_entropy
from prefrank.llm.substring_dedup_queries import op2_paragraph_minhash
from prefrank.llm.toxicity_queries import op1_noisy_or
from prefrank.llm.url_filter_queries import OP3_SQL, op3_blocked_bloom

QUERIES = {
    "op1_noisy_or": op1_noisy_or,
    "op2_paragraph_minhash": op2_paragraph_minhash,
    "op3_blocked_bloom": op3_blocked_bloom,
    "op4_probminhash": op4_probminhash,
    "op5_best_fit": op5_best_fit,
    "op6_boosted_trees": op6_boosted_trees,
    "op7_block_max_wand": op7_block_max_wand,
    "op8_sentence_rules": op8_sentence_rules,
    "op9_entropy": op9_entropy,
    "op10_line_first": op10_line_first,
    "op11_prefix_table": op11_prefix_table,
    "op12_debruijn": op12_debruijn,
    "op13_retraction_audit": op13_retraction_audit,
}
ORACLES = {
    "op12_debruijn": OP12_SQL,
    "op13_retraction_audit": OP13_SQL,
    "op3_blocked_bloom": OP3_SQL,
    "op8_sentence_rules": OP8_SQL,
}
