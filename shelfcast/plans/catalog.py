"""All registered queries; importing a module registers its queries."""

from . import q_features, q_panel, q_patterns, q_forecast, q_hybrid, q_models, q_planted, q_items, q_pooling, q_quantile, q_reconcile, q_smooth, q_stream, q_structure  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
