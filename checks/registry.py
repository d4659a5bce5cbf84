"""All registered queries."""

from checks import model_queries  # noqa: F401  (registers its queries)
from checks.pipeline_queries import QUERIES

__all__ = ["QUERIES"]
