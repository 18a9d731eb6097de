"""All registered queries."""

from workload import suite_documents, suite_models, suite_plays, suite_quality, suite_ratings  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
