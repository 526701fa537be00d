"""Queries by name, and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from lodestone.plans import registry

_MODULES = ("prepare", "mine")


def _load() -> None:
    for m in _MODULES:
        import_module(f"lodestone.plans.{m}")


def all_queries() -> dict:
    _load()
    return registry.QUERIES


def all_sql() -> dict[str, str]:
    _load()
    return registry.SQL
