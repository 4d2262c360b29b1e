"""All queries of the library and their SQL equivalents."""

from __future__ import annotations

from .plans import analytics, features, linking

QUERIES = features.QUERIES | linking.QUERIES | analytics.QUERIES
ORACLES = features.ORACLES | linking.ORACLES | analytics.ORACLES
