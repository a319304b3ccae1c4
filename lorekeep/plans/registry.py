"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from . import candidates, contexts, conversations, fact_search, fact_sources, facts_recall, grounding, matching, overviews, recall, recall_ledger, relations, snapshots, streams, topics_life, transfers, vector_index  # noqa: F401  (importing a module registers its queries)

QUERIES: dict = {**recall.QUERIES}
SQL: dict[str, str] = {**recall.SQL}
