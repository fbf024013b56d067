"""All named queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from . import aggregates, clusters, functions, joins, layouts, pictures, quality, state, stories, streams  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
