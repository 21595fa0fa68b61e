"""Distribution-drift monitoring over sensor fleets, as Spark DataFrame jobs."""

from driftspark.functions.distances import available_metrics
from driftspark.session import get_spark

__all__ = ["available_metrics", "get_spark"]
