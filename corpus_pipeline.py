"""The corpus pipeline, part of the subpackage ``weft.llm``: its stages, their run, and no SQL."""

from __future__ import annotations

from weft.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
