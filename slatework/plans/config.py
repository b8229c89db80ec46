"""Search settings, passed explicitly."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from slatework.functions.english import ANALYSERS

BACKENDS = ("tables", "graph")


@dataclass(frozen=True)
class SearchConfig:
    """Backend (tables or graph), hybrid retrieval, fallback to the graph when a table search is empty, analysis of words (english or simple)."""

    backend: str = "tables"
    hybrid: bool = True
    fallback: bool = True
    analysis: str = "english"

    def __post_init__(self):
        if self.backend not in BACKENDS:
            raise ValueError(f"unknown backend {self.backend!r}; one of {', '.join(BACKENDS)}")
        if self.analysis not in ANALYSERS:
            raise ValueError(f"unknown analysis {self.analysis!r}; one of {', '.join(ANALYSERS)}")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "SLATEWORK_") -> SearchConfig:
        """<prefix>BACKEND, <prefix>HYBRID, <prefix>FALLBACK (only "true" in any case is true) and <prefix>ANALYSIS."""
        flag = lambda name: env.get(prefix + name, "true").lower() == "true"
        return cls(env.get(prefix + "BACKEND", "tables").lower(), flag("HYBRID"), flag("FALLBACK"), env.get(prefix + "ANALYSIS", "english").lower())

    def frame(self, spark: SparkSession) -> DataFrame:
        """setting, value."""
        return spark.createDataFrame([("backend", self.backend), ("hybrid", str(self.hybrid).lower()), ("fallback", str(self.fallback).lower()), ("analysis", self.analysis)], "setting string, value string")
