"""All registered queries and their SQL."""

from terrane.plans import evidence_queries, model_queries, relational_queries, spatial_queries  # noqa: F401
from terrane.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401
