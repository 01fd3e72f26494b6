"""The corpus pipeline's stages and run(); they live in the training-data subpackage."""

from tidemill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
