"""Registered queries and the SQL that checks them."""

from cinderlog.plans import export, ingest, reports, search, streams, telemetry  # noqa: F401
from cinderlog.plans.registry import oracles, queries  # noqa: F401
