"""Names and times of stages: a profiler protocol, one that does nothing, one for Spark jobs."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from typing import Protocol, runtime_checkable

from pyspark.sql import SparkSession


@runtime_checkable
class Profiler(Protocol):
    def profile(self, name: str) -> AbstractContextManager: ...


class NullProfiler:
    @contextmanager
    def profile(self, name: str) -> Iterator[None]:
        yield


class JobProfiler:
    """Describes the jobs of each stage in Spark's listings and keeps wall-clock seconds."""

    def __init__(self, spark: SparkSession):
        self.spark, self.seconds = spark, {}

    @contextmanager
    def profile(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        self.spark.sparkContext.setJobDescription(name)
        try:
            yield
        finally:
            self.spark.sparkContext.setJobDescription("")
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
