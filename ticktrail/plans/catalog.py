"""The queries of the engine by name, with the SQL that states each independently."""

from __future__ import annotations

from . import control_plans, factor_plans, lake_plans, market_plans, message_plans, quality_plans, replay_plans, scalar_plans, source_plans  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
