"""All queries of the library by name, each with the SQL that it is checked against."""

from __future__ import annotations

import importlib
import pkgutil

from . import plans
from .plans.base import QUERIES, SQL, Query


def _load() -> None:
    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"{plans.__name__}.{module.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
