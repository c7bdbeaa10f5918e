"""All queries of the engine, with their SQL for the check."""

from terrafuse.plans import q_buildings, q_graph, q_layers, q_polygons, q_projections, q_sets, q_space, q_text, q_votes  # noqa: F401  they register themselves
from terrafuse.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
