"""Query name to callable, and to DuckDB SQL where SQL can express the query."""

from __future__ import annotations

from boutline.plans import boost_queries, bout_queries, career_queries, claim_queries, feed_queries, fit_queries, market_queries, model_queries, question_queries, source_queries, stream_queries, text_queries

_PARTS = (career_queries, boost_queries, bout_queries, claim_queries, market_queries, feed_queries, question_queries, source_queries, text_queries, stream_queries, model_queries, fit_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
