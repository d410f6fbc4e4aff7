"""Every runnable query on the driver tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

import importlib

from haulmark.catalog.base import ORACLES, QUERIES

MODULES = ("ledger", "scalars", "mirror", "telemetry", "logs", "files", "streams")

for _module in MODULES:
    importlib.import_module(f"haulmark.catalog.{_module}")

__all__ = ["ORACLES", "QUERIES"]
