"""Every query of the reference's own operators, with its SQL."""

from . import bench_queries, graph_queries, rank_queries, source_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
