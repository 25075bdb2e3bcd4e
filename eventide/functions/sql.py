"""The catalogue's scalar functions for SQL, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.predicates import DURATION_YEARS, FUTURE_YEARS, OUTSIDE
from .text import _folding


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_functions(spark: SparkSession) -> None:
    """normalize_location(s), is_outside_territory(a, b, c, d) and is_temporally_invalid(kind, permanent, start, end, year)."""
    old, new = map(_literal, _folding())
    marks = "concat('[', chr(92), 'u0300-', chr(92), 'u036f]')"
    body = f"coalesce(trim(BOTH '-' FROM regexp_replace(lower(regexp_replace(translate(s, {old}, {new}), {marks}, '')), '[^a-z0-9]+', '-')), '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_location(s STRING) RETURNS STRING RETURN {body}")
    tests = " OR ".join(f"coalesce(replace(normalize_location({x}), '-', ' ') RLIKE {_literal(OUTSIDE)}, false)" for x in "abcd")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_outside_territory(a STRING, b STRING, c STRING, d STRING) RETURNS BOOLEAN RETURN {tests}")

    def day(x: str) -> str:
        return f"CASE WHEN {x} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN CAST(try_to_timestamp({x}, 'yyyy-MM-dd') AS DATE) END"

    a, b = day("first"), day("last")
    later = f"CASE WHEN month({a}) = 2 AND dayofmonth({a}) = 29 AND dayofmonth(add_months({a}, {12 * DURATION_YEARS})) = 28 THEN date_add(add_months({a}, {12 * DURATION_YEARS}), 1) ELSE add_months({a}, {12 * DURATION_YEARS}) END"
    wrong = f"(first IS NOT NULL AND ({a}) IS NULL) OR (last IS NOT NULL AND ({b}) IS NULL)"
    fault = f"{wrong} OR coalesce(({b}) < ({a}), false) OR coalesce(greatest(year({a}), year({b})) > current + {FUTURE_YEARS}, false) OR coalesce(({b}) > ({later}), false)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION is_temporally_invalid(kind STRING, permanent INT, first STRING, last STRING, current INT) RETURNS BOOLEAN "
        f"RETURN coalesce(kind = 'event', false) AND NOT coalesce(permanent = 1, false) AND ({fault})"
    )
