"""The queries of this package and their SQL."""

from __future__ import annotations

import corpus_pipeline
from netloom.llm import decontaminate, nearest, pieces, quality, simhash, substring_dedup, suffix_dedup, token_counts, token_files, url_filter

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_simhash": simhash.op1_simhash,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_token_files": token_files.op3_token_files,
    "op4_quality": quality.op4_quality,
    "op5_pieces": pieces.op5_pieces,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_nearest": nearest.op7_nearest,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
}
ORACLE_SQL = {"op10_url_filter": url_filter.OP10_SQL}
