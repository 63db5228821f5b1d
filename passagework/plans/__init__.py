"""Named plans and their SQL."""

from . import assembly, corpus, retrieval, scoring

QUERIES = corpus.QUERIES | retrieval.QUERIES | scoring.QUERIES | assembly.QUERIES
SQL = corpus.SQL | retrieval.SQL | scoring.SQL | assembly.SQL
