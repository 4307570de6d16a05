"""All registered queries."""

from __future__ import annotations

from regionflow.plans import (  # noqa: F401
    chain_queries,
    mapping_queries,
    outcome_queries,
    pixel_queries,
    region_queries,
    reply_queries,
    stream_queries,
    text_queries,
)
from regionflow.plans.registry import BUILDS, QUERIES, SQL  # noqa: F401
