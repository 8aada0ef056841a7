"""All queries of the package: importing this module registers them."""

from crowdtide.llm import decontaminate, html_text, knn, language_id, line_dedup, lm_score, near_dup, packing, piece_codec, prefix_trie, runs, token_counts, toxicity  # noqa: F401
from crowdtide.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
