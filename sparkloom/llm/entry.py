"""The queries of the training-data operators and, where SQL can say it, their oracle."""

import corpus_pipeline

from . import op1_topk, op2_pitman_yor, op3_chat, op4_packing, op5_langid, op6_url_filter, op7_line_dedup, op8_simhash, op9_sharding, op10_decontaminate, op11_alignment, op12_odd_sketch, op13_dual_tree

QUERIES = {
    "op1_exact_topk": op1_topk.op1_exact_topk,
    "op2_pitman_yor": op2_pitman_yor.op2_pitman_yor,
    "op3_chat_format": op3_chat.op3_chat_format,
    "op4_packing": op4_packing.op4_packing,
    "op5_langid": op5_langid.op5_langid,
    "op6_url_filter": op6_url_filter.op6_url_filter,
    "op7_line_dedup": op7_line_dedup.op7_line_dedup,
    "op8_simhash": op8_simhash.op8_simhash,
    "op9_sharding": op9_sharding.op9_sharding,
    "op10_decontaminate": op10_decontaminate.op10_decontaminate,
    "op11_alignment": op11_alignment.op11_alignment,
    "op12_odd_sketch": op12_odd_sketch.op12_odd_sketch,
    "op13_dual_tree": op13_dual_tree.op13_dual_tree,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_exact_topk": op1_topk.ORACLE, "op3_chat_format": op3_chat.ORACLE, "op6_url_filter": op6_url_filter.ORACLE, "op7_line_dedup": op7_line_dedup.ORACLE, "op12_odd_sketch": op12_odd_sketch.ORACLE, "op13_dual_tree": op13_dual_tree.ORACLE}
