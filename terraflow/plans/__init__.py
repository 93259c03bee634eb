"""Registered queries; importing the package fills the registry."""

from importlib import import_module

from terraflow.plans.registry import ORACLES, QUERIES

for _name in (
    "scalar_queries",
    "dam_queries",
    "rule_queries",
    "run_queries",
    "particle_queries",
    "raster_queries",
    "flow_queries",
    "terrain_queries",
    "site_queries",
    "stream_queries",
):
    import_module(f"terraflow.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
