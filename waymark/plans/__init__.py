"""Query plans over the driver tables."""

from . import analytics, cleaning, feature_queries, gold_queries, graph_queries, model_queries, network_queries, row_queries, snapshot_queries, table_queries, weather_queries  # noqa: F401  each module registers its queries
