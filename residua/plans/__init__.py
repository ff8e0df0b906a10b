"""The query registry: each module adds named plans with their SQL twins."""

from .base import ORACLES, QUERIES
from . import (  # noqa: F401
    coverage,
    delta_tables,
    generator_plans,
    ledger_plans,
    motif_plans,
    residual_plans,
    row_plans,
    source_plans,
    stat_plans,
    stream_plans,
    window_plans,
)

__all__ = ["ORACLES", "QUERIES"]
