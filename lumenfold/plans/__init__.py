"""The engine's queries; importing the package registers all of them."""

from . import dialogue, ingest, retrieval, streams, uploads  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
