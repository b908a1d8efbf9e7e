"""Queries of the corpus operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from waneline.llm import decontaminate, fingerprints, jaccard, langid, licenses, packing, repeats, secrets, toxicity, warc

_MODULES = (secrets, repeats, licenses, packing, decontaminate, warc, langid, fingerprints, jaccard, toxicity)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
