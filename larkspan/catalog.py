"""Imports every module that registers queries and exposes the two dictionaries."""

from __future__ import annotations

import importlib

from larkspan import registry

MODULES = (
    "operators.project",
    "operators.joins",
    "operators.aggregates",
    "operators.intervals",
    "operators.windows",
    "operators.sorting",
    "operators.sets",
    "operators.reshape",
    "operators.udfs",
    "functions.aggregate_pack",
    "functions.scalar_packs",
    "functions.collection_packs",
    "sources.files",
    "sources.broken",
    "plans.scoring",
    "plans.comparison",
    "plans.metrics",
    "plans.runs",
    "plans.generation",
    "plans.training",
    "plans.networks",
    "plans.graph",
    "plans.features",
    "plans.isotonic",
    "plans.similarity",
    "plans.learning",
    "plans.statistics",
    "plans.blocks",
    "streaming.windows",
    "streaming.state",
    "streaming.sinks",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"larkspan.{name}")


def queries() -> dict[str, registry.Query]:
    _load()
    return registry.QUERIES


def oracle() -> dict[str, str]:
    _load()
    return registry.ORACLE
