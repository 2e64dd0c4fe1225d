"""The named queries and the SQL that each is held against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("eda", "prepare", "learn", "extended", "relational")


def _all() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"lexiloom.plans.{m}").Q
    return out


def queries() -> dict:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
