"""Imports every catalogue module, which fills the registry."""

from ticklattice.plans import analysis_catalog, book_catalog, feeds_catalog, model_catalog, stream_catalog, windows_catalog  # noqa: F401
from ticklattice.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
