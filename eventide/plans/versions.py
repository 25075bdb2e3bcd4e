"""Versions of the stored relations: steps in order, each applied once and recorded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES, seeded_categories

State = dict[str, DataFrame]
LEDGER = "name string, applied_at string"


def _relations(spark: SparkSession, st: State) -> State:
    """Relations and columns that are missing, empty."""
    out = dict(st)
    for name, schema in TABLES.items():
        wanted = spark.createDataFrame([], schema)
        have = out.get(name, wanted)
        missing = {f.name: F.lit(None).cast(f.dataType) for f in wanted.schema if f.name not in have.columns}
        out[name] = have.withColumns(missing) if missing else have
    return out


def _categories(spark: SparkSession, st: State) -> State:
    return st | {"categories": seeded_categories(spark, st["categories"])}


STEPS: list[tuple[str, Callable[[SparkSession, State], State]]] = [("001_relations", _relations), ("002_categories", _categories)]


def migrate(spark: SparkSession, st: State, ledger: DataFrame | None, now: str, steps=STEPS) -> tuple[State, DataFrame]:
    """The state after all steps that the ledger lacks, and the new ledger."""
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger
    done = {r["name"] for r in ledger.select("name").collect()}
    new = [(name, f) for name, f in sorted(steps, key=lambda s: s[0]) if name not in done]
    for _, f in new:
        st = f(spark, st)
    return st, ledger.union(spark.createDataFrame([(name, now) for name, _ in new], LEDGER))
