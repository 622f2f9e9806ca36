"""All registered queries by name."""

from __future__ import annotations

from limnos.plans import community, isotopes, lakes, ordination, profiles, regression, tables

MODULES = [profiles, lakes, community, ordination, isotopes, regression, tables]


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
