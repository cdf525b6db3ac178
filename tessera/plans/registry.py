"""All registered queries and their SQL twins."""

from __future__ import annotations

from . import queries_axis, queries_functions, queries_geodesic, queries_geometry, queries_grid, queries_more, queries_overlay, queries_period  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401

FLAGSHIP = "binning2d"
