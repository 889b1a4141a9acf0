"""Collects the registered queries of every plan module."""

from __future__ import annotations

import importlib

MODULES = ("curation", "rules", "matching", "texts", "vectors", "duplicates", "layout", "nested", "relational", "streams", "files", "pictures")


def _families():
    return [importlib.import_module(f"gleanery.plans.{name}") for name in MODULES]


def queries() -> dict:
    return {name: run for family in _families() for name, run in family.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for family in _families() for name, sql in family.ORACLE_SQL.items()}
