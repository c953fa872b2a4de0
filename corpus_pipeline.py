"""The corpus pipeline of the corpus operators, for those who look for it at the top."""

from pagewright.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
