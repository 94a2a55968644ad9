"""The queries of this subpackage, one per operator, and the SQL of those that have it."""

from . import bpe, compression, debruijn, leaks, metricjoin, minmax, pseudonyms, secrets, separators, toxicity

MODULES = (separators, debruijn, pseudonyms, leaks, bpe, secrets, compression, minmax, toxicity, metricjoin)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
