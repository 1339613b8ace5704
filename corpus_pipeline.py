"""From documents to packed training sequences: quality, language, near-duplicates, mixing, packing."""

from siftwork.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
