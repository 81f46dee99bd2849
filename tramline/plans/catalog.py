"""All registered queries of the mobility engine and their SQL twins."""

from __future__ import annotations

from tramline.plans import corridors, files, graphs, lines, maps, pieces, roads, texts, trips
from tramline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corridors", "files", "graphs", "lines", "maps", "pieces", "roads", "texts", "trips"]
