"""Registered queries. Importing the query modules fills the registry."""

from importlib import import_module

MODULES = [
    "graph_queries",
    "spectral_queries",
    "table_queries",
    "spatial_queries",
    "run_queries",
    "raster_queries",
    "network_queries",
    "figure_queries",
]


def load_all() -> None:
    for name in MODULES:
        import_module(f"graphloom.plans.{name}")
