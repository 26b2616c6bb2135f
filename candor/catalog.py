"""All registered queries and their DuckDB equivalents, by name."""

from __future__ import annotations

from candor.plans import metric_queries, model_queries, number_queries, source_queries, stream_queries, table_queries, text_queries

FLAGSHIP = "answer_risk"
_PARTS = [text_queries, number_queries, metric_queries, model_queries, source_queries, stream_queries, table_queries]
QUERIES = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _PARTS for k, v in m.ORACLES.items()}
