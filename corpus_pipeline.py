"""The corpus pipeline of quarry.llm: STAGES, run() and ORACLE_SQL."""

from quarry.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
