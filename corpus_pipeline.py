"""The corpus pipeline: its stages are in ``treeline.llm.pipeline``."""

from treeline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
