"""Registered queries: a Spark builder and, where expressible, its SQL twin."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from voxloom.session import prepare


class Tables:
    """Column-pruned access to the parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = prepare(spark)
        self.root = root

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.root, f"{name}.parquet"))


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register


def with_ctes(*parts: str) -> str:
    """Join CTE texts and a final SELECT into one statement."""
    *ctes, body = [p.strip().rstrip(",") for p in parts]
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body
