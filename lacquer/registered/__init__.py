"""Registered queries; each module pairs a Spark query over the given tables with its SQL."""

from __future__ import annotations

import importlib
import os
import pkgutil


def load():
    from .common import ORACLES, QUERIES

    for m in sorted(m.name for m in pkgutil.iter_modules([os.path.dirname(__file__)])):
        if m != "common":
            importlib.import_module(f"{__name__}.{m}")
    return QUERIES, ORACLES
