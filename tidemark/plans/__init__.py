"""The catalogue of queries."""

from . import actions, evaluation, features, pages, products, records, rollouts, sequences, streams, structure, trajectories, turns, variants  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
