"""All queries of the sensor engine and, where SQL can express them, their DuckDB SQL."""

from photonlake.plans import event_queries, frame_queries, live_queries, message_queries, sensor_queries
from photonlake.plans.register import ORACLE, QUERIES

MODULES = (event_queries, message_queries, sensor_queries, frame_queries, live_queries)
__all__ = ["MODULES", "ORACLE", "QUERIES"]
