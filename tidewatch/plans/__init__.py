"""Queries over the driver's tables, by theme."""

import importlib

#: Modules of this package that register queries.
MODULES: tuple[str, ...] = ("extracting", "files", "gating", "grouping", "judging", "linking", "ranges", "rejudging", "reporting", "reranking", "search")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
