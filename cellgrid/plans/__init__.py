"""Fixture bindings and the query catalog (operator calls with their SQL oracles)."""

from importlib import import_module

MODULES = ("q_sources", "q_project", "q_voxels", "q_similarity", "q_geometry", "q_curves", "q_expression",
           "q_sampling", "q_taxonomy", "q_classify", "q_work")


def load_all():
    """Import every query module; returns (queries, oracles)."""
    for name in MODULES:
        import_module(f"cellgrid.plans.{name}")
    from cellgrid.plans.catalog import ORACLES, QUERIES
    return QUERIES, ORACLES
