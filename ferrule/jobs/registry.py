"""All queries of the library, gathered from the job modules: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from ferrule.jobs import audits, catalogue, choices, insql, lanes, lifecycle, logs, prompts, ranking, routing, scaffold, signals, stored, streams

_ALL = ranking.QUERIES | prompts.QUERIES | signals.QUERIES | streams.QUERIES | choices.QUERIES | scaffold.QUERIES | catalogue.QUERIES | lifecycle.QUERIES | stored.QUERIES | routing.QUERIES | lanes.QUERIES | logs.QUERIES | insql.QUERIES | audits.QUERIES


def queries() -> dict:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
