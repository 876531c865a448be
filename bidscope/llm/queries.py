"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from bidscope.llm import exact_dedup, fill_middle, fingerprints, language, licences, mixing, packing, sharding, simhash, suffix_dedup, url_filter, vector_codes, warc

_MODULES = (warc, fingerprints, language, exact_dedup, url_filter, suffix_dedup, mixing, packing, simhash, sharding, licences, vector_codes, fill_middle)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
