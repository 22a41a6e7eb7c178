"""The queries of the operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pagelens.llm import decontaminate, htmltext, jaccard, lines, packing, quality, substrings, tokens, topk, warc

QUERIES = {
    "op1_token_blocks": tokens.op1_token_blocks,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_packing": packing.op6_packing,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_warc": warc.op8_warc,
    "op9_quality": quality.op9_quality,
    "op10_html": htmltext.op10_html,
}
ORACLE_SQL = {"op3_ngram_jaccard": jaccard.ORACLE_SQL, "op4_substring_dedup": substrings.ORACLE_SQL, "op2_line_dedup": lines.ORACLE_SQL, "op5_exact_topk": topk.ORACLE_SQL, "op7_decontaminate": decontaminate.ORACLE_SQL}
