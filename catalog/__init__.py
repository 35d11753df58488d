"""Queries over the given tables, one per operator."""

from catalog import cleaning, columns, domain, joins, loops, scoring, splits, stored, stumps, trees
from catalog.registry import ORACLES, QUERIES

MODULES = (cleaning, splits, scoring, joins, loops, trees, stumps, stored, columns, domain)


def all_queries():
    return QUERIES


def all_oracles():
    return ORACLES
