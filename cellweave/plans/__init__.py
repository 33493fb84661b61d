"""Registered queries; importing the groups fills the registry."""

from cellweave.plans.registry import ORACLES, QUERIES
from cellweave.plans import q_frontier, q_ledger, q_metrics, q_places, q_raster, q_routes, q_sampling, q_sky, q_sources, q_timetable, q_vector  # noqa: F401, E402  isort: skip

__all__ = ["ORACLES", "QUERIES"]
