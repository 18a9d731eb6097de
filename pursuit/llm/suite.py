"""All registered queries of the subpackage."""

from pursuit.llm import (  # noqa: F401
    chat_format, decontaminate, hard_negatives, html_extract, language_id, mixing, ngram_join, periodic_runs, piece_codec,
    quality, suffix_dedup, token_counts, topk_search)
from pursuit.llm.registry import ORACLES, QUERIES  # noqa: F401
