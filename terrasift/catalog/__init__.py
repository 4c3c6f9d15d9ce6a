"""Registered queries: name -> (callable, DuckDB text or None), one module per operator family."""

from importlib import import_module

FAMILIES = ["scans", "columns", "places", "joining", "aggregates", "windows", "sets", "sites", "designs", "predictors", "jobs", "streams"]


def all_queries():
    out = {}
    for f in FAMILIES:
        try:
            mod = import_module(f"terrasift.catalog.{f}")
        except ModuleNotFoundError as e:
            if e.name != f"terrasift.catalog.{f}":
                raise
            continue
        for name, pair in mod.QUERIES.items():
            assert name not in out, name
            out[name] = pair
    return out
