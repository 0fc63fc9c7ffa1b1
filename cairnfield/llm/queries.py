"""Queries of this subpackage and the SQL of those that SQL can express."""

from . import audio, bpe, idfiles, language, packing, quality, secrets, sharding, simhash, urls

_MODULES = (packing, bpe, secrets, quality, language, simhash, urls, audio, idfiles, sharding)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
