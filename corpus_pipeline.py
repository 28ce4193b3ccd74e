"""The corpus pipeline under the name that the driver asks for; its stages are in the subpackage llm."""

from helixframe.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
