"""All registered queries of the engine with their SQL twins.

The test tables stand in for the domain: documents are snippets (source is the codebase, lang the language),
embeddings the vector store (vec_id joins doc_id), benchmark a batch of queries, pages linked files, events a feed and
a load test, and region to lineitem a containment hierarchy.
"""

from __future__ import annotations

from slatework.plans import queries_analytics, queries_changes, queries_graph, queries_search

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (queries_search, queries_analytics, queries_changes, queries_graph):
    QUERIES |= _module.CATALOGUE.queries
    ORACLES |= _module.CATALOGUE.oracles
