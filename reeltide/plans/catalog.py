"""All named queries and the SQL that gives the same rows."""
from __future__ import annotations

import importlib
import pkgutil

from ..session import tune
from . import __path__ as _here


def _parts():
    return [importlib.import_module(f"{__package__}.{m.name}") for m in pkgutil.iter_modules(_here) if m.name.startswith("catalog_")]


def _tuned(query):
    return lambda spark, sf_dir: query(tune(spark), sf_dir)


def queries() -> dict:
    return {name: _tuned(q) for part in _parts() for name, q in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for part in _parts() for name, q in part.ORACLE.items()}
