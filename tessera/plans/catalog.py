"""All queries of this library but those of subpackages, and their SQL."""

from __future__ import annotations

from . import factsql, moresql, questionsql, tablesql, texts  # noqa: F401 - they register their queries
from .texts import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
