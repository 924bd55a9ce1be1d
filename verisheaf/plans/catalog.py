"""Collects the queries of every plan module and the SQL that states their expected rows."""

from __future__ import annotations


def _modules():
    from verisheaf.plans import check_plans, io_plans, pair_plans, quality_plans, stats_plans, text_plans

    return [check_plans, io_plans, pair_plans, quality_plans, stats_plans, text_plans]


def queries() -> dict:
    return {name: fn for module in _modules() for name, (fn, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, (_, sql) in module.QUERIES.items() if sql}
