"""Every registered query of the timeline engine, with its SQL."""

from __future__ import annotations

from strandline.plans.base import ORACLE, QUERIES
from strandline.plans.queries import activity, exports, jobs, lookup, maps, matching, reading, spacing, texts, timings

__all__ = ["ORACLE", "QUERIES", "activity", "exports", "jobs", "lookup", "maps", "matching", "reading", "spacing", "texts", "timings"]
