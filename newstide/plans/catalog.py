"""All queries over the reference tables, with the SQL that checks them."""

from __future__ import annotations

from . import aggregating, computing, evaluating, flowing, joining, learning, scans, selecting, windows  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
