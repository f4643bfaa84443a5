"""All queries of the retrieval engine with their SQL equivalents."""

from __future__ import annotations

from .plans import answers, evaluation, extraction, files, governance, indexing, lifecycle, reports, retrieval, segmentation, streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _family in (segmentation, retrieval, answers, evaluation, governance, reports, indexing, extraction, lifecycle, files, streams):
    QUERIES |= _family.PLANS.queries
    ORACLES |= _family.PLANS.oracles
