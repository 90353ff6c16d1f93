"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import corpus, quality, retrieval

QUERIES = {**retrieval.QUERIES, **corpus.QUERIES, **quality.QUERIES}
SQL = {**retrieval.SQL, **corpus.SQL, **quality.SQL}
