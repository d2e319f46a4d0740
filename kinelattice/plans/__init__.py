"""Registered queries; the other modules add to the tables of ``catalog``."""

from kinelattice.plans import catalog, runs, scenes

__all__ = ["catalog", "runs", "scenes"]
