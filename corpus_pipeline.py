"""A training corpus from raw documents, in five stages of ``quern.llm.pipeline``.

Counted as part of ``quern.llm``: it goes when that folder goes.
"""

from quern.llm.pipeline import CAPACITY, ORACLE_SQL, STAGES, exact_stage, language_stage, near_stage, packing_stage, quality_stage, run

__all__ = ["CAPACITY", "ORACLE_SQL", "STAGES", "exact_stage", "language_stage", "near_stage", "packing_stage", "quality_stage", "run"]
