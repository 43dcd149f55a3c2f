"""The corpus pipeline: quality rules, toxicity, n-gram Jaccard join, best-fit packing."""

from __future__ import annotations

from tidemark.llm import pipeline

STAGES, ORACLE_SQL, run = pipeline.STAGES, None, pipeline.run
