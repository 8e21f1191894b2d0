"""All queries of the engine by name, without the training-data operators."""

from __future__ import annotations

from tessera.plans import agents, documents, extras, indexes, more, retrieval, streams

QUERIES = {**retrieval.QUERIES, **agents.QUERIES, **documents.QUERIES, **extras.QUERIES, **more.QUERIES, **indexes.QUERIES, **streams.QUERIES}
SQL = {**retrieval.SQL, **agents.SQL, **documents.SQL, **extras.SQL, **more.SQL, **indexes.SQL, **streams.SQL}
