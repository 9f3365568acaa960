"""All queries of this subpackage and their SQL twins."""

from lanternway.llm.queries import QUERIES
from lanternway.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]
