"""All registered queries of this subpackage and their equivalent SQL."""

from __future__ import annotations

from lucerna.llm import alignment, exact_topk, extract, hard_negatives, host_quality, langid, line_dedup, mixing, nn_descent, packing, simhash, token_counts, toxicity  # noqa: F401  (importing registers)
from lucerna.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
