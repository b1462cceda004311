"""Every registered audit query with its DuckDB counterpart."""

from __future__ import annotations

from ledgerlake.plans import (  # noqa: F401  importing registers
    blocks,
    conditions,
    functions,
    joins,
    ledger,
    lines,
    mining,
    rollups,
    rulebook,
    sources,
    streams,
    windows,
)
from ledgerlake.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
