"""Training-corpus pipeline over `documents`: its stages are in `tracewell.llm.pipeline`."""

from tracewell.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
