"""Named data sets with declared predictors and response."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from priorform.sources.tables import Tables


@dataclass(frozen=True)
class DatasetSpec:
    """A frame builder plus the roles of its columns."""

    name: str
    build: Callable[[Tables], DataFrame]
    predictors: tuple[str, ...]
    response: str

    def load(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder)).select(*self.predictors, self.response)


class DatasetRegistry:
    """Data sets by name; an unknown name raises, no name draws one."""

    def __init__(self, specs: tuple[DatasetSpec, ...] = ()):
        self._specs = {s.name: s for s in specs}

    def add(self, spec: DatasetSpec) -> DatasetSpec:
        self._specs[spec.name] = spec
        return spec

    def names(self) -> list[str]:
        return sorted(self._specs)

    def choose(self, name: str | None = None, seed: int | None = None) -> DatasetSpec:
        if name is None:
            name = random.Random(seed).choice(self.names())
        if name not in self._specs:
            raise ValueError(f"unknown data set {name!r}; known: {self.names()}")
        return self._specs[name]
