"""Registered queries over the shared tables, each with its SQL check where SQL can express it."""

from __future__ import annotations

import importlib

from sightline.queries.registry import ORACLES, QUERIES

GROUPS = (
    "profile",
    "quality",
    "cleaning",
    "timeseries",
    "statistics",
    "learning",
    "charts",
    "sources",
)


def load() -> tuple[dict, dict]:
    for group in GROUPS:
        importlib.import_module(f"sightline.queries.{group}")
    return QUERIES, ORACLES
