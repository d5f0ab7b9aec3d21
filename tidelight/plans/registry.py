"""All registered queries."""

from __future__ import annotations

from . import chain_queries, long_queries, name_queries, population_queries, series_queries, sky_queries, time_queries

MODULES = [series_queries, time_queries, sky_queries, name_queries, population_queries, chain_queries, long_queries]


def all_queries():
    out = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def all_oracles():
    out = {}
    for m in MODULES:
        out.update(m.ORACLE)
    return out
