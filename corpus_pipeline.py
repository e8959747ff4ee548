"""The corpus pipeline over `documents`: each stage works on what the one before it kept."""

from __future__ import annotations

from lawloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
