"""All registered queries and their SQL twins."""

from __future__ import annotations

from quillon.plans import board, canonical, features, metrics, models, scalars, streams  # noqa: F401  (they register their queries)
from quillon.plans.catalog import QUERIES, SQL, Query

FLAGSHIP = "chunk_features"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
