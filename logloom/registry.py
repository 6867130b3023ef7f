"""All queries outside the training-data folder."""

from logloom.plans import detail_queries, lifecycle_queries, linking_queries, streaming_queries, telemetry_queries  # noqa: F401  add their queries
from logloom.plans.queries import ORACLE_SQL, QUERIES  # noqa: F401
