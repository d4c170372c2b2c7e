"""Every registered query and its DuckDB oracle."""

from gazette.plans import aggregates, html, joins, model, ranking, relational, scalars, sources  # noqa: F401
from gazette.plans.registry import QUERIES, SQL  # noqa: F401
