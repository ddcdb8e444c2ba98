"""Collects the queries of every plan module: name -> (callable, SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ["scans", "rows", "joins", "reports", "timeplits", "scoring", "resampling", "explain", "learning", "endtoend"]


class Book(dict):
    """Registers ``fn`` under its own name together with its SQL twin."""

    def query(self, sql: str | None = None):
        def wrap(fn):
            self[fn.__name__] = (fn, sql)
            return fn

        return wrap


def collect() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(importlib.import_module(f"tidemark.plans.{m}").BOOK)
    return out
