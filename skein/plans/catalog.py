"""All queries of the core by name, and the SQL that gives the same rows."""

from __future__ import annotations

from skein.plans import problems, queries

FLAGSHIP = "corpus_edges"
QUERIES = {**problems.QUERIES, **queries.QUERIES}
ORACLES = {**problems.ORACLES, **queries.ORACLES}
