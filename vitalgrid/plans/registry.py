"""All named queries and their SQL."""

from __future__ import annotations

from . import cohort, evaluation, extra, flows, graph, groups, metrics, overlap, prompts, reshape, text, traces  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
