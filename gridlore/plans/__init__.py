"""Registered queries over derived features, each with a DuckDB twin where SQL can express it."""

from gridlore.plans import layers, queries, scans, shapes  # noqa: F401  their queries register themselves
from gridlore.plans.registry import QUERIES, SQL  # noqa: F401
