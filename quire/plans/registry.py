"""The registered queries of the engine and their SQL for the oracle."""

from __future__ import annotations

from quire.plans import editing, fidelity, publishing, records, retrieval, structure

QUERIES = fidelity.QUERIES | structure.QUERIES | retrieval.QUERIES | editing.QUERIES | records.QUERIES | publishing.QUERIES
ORACLES = fidelity.ORACLES | structure.ORACLES | retrieval.ORACLES | editing.ORACLES | records.ORACLES | publishing.ORACLES
#: Per page: recall, extra, composite and verdict.
FLAGSHIP = fidelity.page_scores
