"""Loads every query module so that the registry is complete."""

from routeloom.plans.registry import ORACLES, QUERIES
from routeloom.plans import (  # noqa: F401
    q_audit,
    q_contracts,
    q_evidence,
    q_graph,
    q_io,
    q_patches,
    q_proposals,
    q_ranking,
    q_reqlog,
    q_resume,
    q_text,
    q_vectors,
)

from routeloom.plans import flows  # noqa: F401,E402  (uses queries registered above)

__all__ = ["ORACLES", "QUERIES"]
