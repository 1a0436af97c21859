"""Named queries (``queries()``) and their SQL oracles (``oracle_sql()``)."""

from . import consensus, context, conversations, fundamentals, ingest, ordered, screens, store  # noqa: F401,E501
from .catalog import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
