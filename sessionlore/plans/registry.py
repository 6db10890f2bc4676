"""Named queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from .oracle import ORACLE
from .queries import QUERIES as REPORTS
from .transcript_queries import QUERIES as TRANSCRIPTS

QUERIES = REPORTS | TRANSCRIPTS

__all__ = ["ORACLE", "QUERIES"]
