"""All queries of the engine by name, and the SQL that each is compared with."""

from __future__ import annotations

from .plans import documents, further, geodata, images, keypoints, layers, models, more, outlines, overlays, physics, projected, relational, series, shapes  # noqa: F401
from .plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
