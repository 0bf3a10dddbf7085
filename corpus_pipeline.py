"""The corpus pipeline: a corpus made ready for training in five stages, defined in ``memlake.llm.stages``."""

from __future__ import annotations

from memlake.llm.stages import STAGES, drop_near_duplicates, drop_toxic, mix_sources, pack_sequences, redact_personal_data, run

#: SQL cannot express the stages; they are tested in tests/llm.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "drop_near_duplicates", "drop_toxic", "mix_sources", "pack_sequences", "redact_personal_data", "run"]
