"""Collects query builders and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Build] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None):
        """Registers a builder under its function's name; without SQL only its rows are checked."""
        def register(build: Build) -> Build:
            self.queries[build.__name__] = build
            if oracle is not None:
                self.oracles[build.__name__] = oracle
            return build
        return register
