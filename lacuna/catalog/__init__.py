"""The registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from lacuna.catalog import diagnose, models
from lacuna.catalog import checked  # after those whose SQL it shares

assert models and checked
QUERIES: dict = diagnose.QUERIES
ORACLES: dict[str, str] = {k: v for k, v in diagnose.ORACLES.items() if v}
