"""All registered queries; importing this module fills the registry."""

from tidemark.plans import (  # noqa: F401
    q_bars,
    q_windows,
    q_recursive,
    q_screen,
    q_joins,
    q_signals,
    q_ledger,
    q_stats,
    q_series,
    q_streams,
    q_studies,
)
from tidemark.plans.registry import COVERS, QUERIES, oracle_texts

ORACLE_SQL = oracle_texts()

__all__ = ["COVERS", "ORACLE_SQL", "QUERIES"]
