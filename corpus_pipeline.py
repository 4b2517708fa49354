"""Corpus pipeline: toxicity, language, near-duplicates, packing. The stages are in ``riskloom.llm.pipeline``."""

from __future__ import annotations

from riskloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
