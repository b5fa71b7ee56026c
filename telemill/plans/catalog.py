"""All registered queries of the telemetry operators."""

from telemill.plans import analyses, landed, more, pipelines, reports, streams  # noqa: F401
from telemill.plans.registry import ORACLES, QUERIES  # noqa: F401
