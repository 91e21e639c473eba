"""Registered queries and the SQL each one is checked against, one module per operator family."""

from importlib import import_module

FAMILIES = ["cell_queries", "composite_queries", "join_queries", "focal_queries", "profile_queries",
            "class_queries", "zone_queries", "model_queries", "io_queries", "gate_queries"]


def load_all() -> None:
    for name in FAMILIES:
        import_module(f"heatgrid.plans.{name}")
