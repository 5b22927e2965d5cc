"""Queries of this subpackage and their SQL."""

from . import chat, langid, lines, mixing, neardup, packing, permutation, secret_scan, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_chat_format": chat.op2,
    "op3_line_dedup": lines.op3,
    "op4_secret_scan": secret_scan.op4,
    "op5_permutation_index": permutation.op5,
    "op6_language_id": langid.op6,
    "op7_ngram_jaccard": neardup.op7,
    "op8_source_mixing": mixing.op8,
    "op9_exact_topk": topk.op9,
    "op10_harmonic_packing": packing.op10,
}
ORACLE_SQL = {"op2_chat_format": chat.SQL, "op8_source_mixing": mixing.SQL, "op9_exact_topk": topk.SQL}
