"""The corpus pipeline as a script finds it; its stages are in ``veilspark.llm.stages``."""

from veilspark.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
