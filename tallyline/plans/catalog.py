"""All registered queries and the SQL each is compared with."""

from __future__ import annotations

from tallyline.operators import defined, dimensions, filters, intervals, listing, lookups, networks, open_calls, products, rating, registration, requests, rollups, rtp, rules, scalars, sequences, series
from tallyline.streaming import jobs, keyed

_MODULES = [intervals, products, filters, lookups, sequences, rules, rating, rollups, scalars, listing, dimensions, series, registration, requests, open_calls, networks, rtp, defined, jobs, keyed]

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
