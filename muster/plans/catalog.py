"""All registered queries; importing the modules fills the registry."""

from __future__ import annotations

from muster.plans import fleet, joins, records, reports, scans, streams  # noqa: F401
from muster.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
