"""All queries over the given tables, by name, with their SQL."""

from __future__ import annotations

from lexispan.plans import alignment_queries, analytics_queries, corpus_queries, evaluation_queries, index_queries, morphology_queries, report_queries  # noqa: F401
from lexispan.plans.tables import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "phrase_exact_of_the"
