"""Registered queries, each next to the SQL that checks it."""

from framewright.catalog import (  # noqa: F401
    aggregates,
    arithmetic,
    curation,
    evaluation,
    folding,
    ordering,
    reports,
    selecting,
    shaping,
    sketching,
    sources,
    texts,
)
from framewright.catalog.registry import QUERIES, SQL  # noqa: F401
