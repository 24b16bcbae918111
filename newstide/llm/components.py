"""Connected components, with the session's checkpoint folder made ready."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import components as stars
from .cluster import checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b), as ``operators.components`` gives them."""
    checkpoint_dir(edges.sparkSession)
    return stars.components(edges)
