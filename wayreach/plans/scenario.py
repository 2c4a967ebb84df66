"""Comparing two finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import compare


def compare_runs(
    first: DataFrame,
    second: DataFrame,
    params1: DataFrame,
    params2: DataFrame,
    cumulative: bool,
    value: str | None = None,
) -> dict[str, DataFrame]:
    """Compared values, rows only one run has, and the parameters side by side.

    ``params``: (position, Parameter, Value). Raises if the runs cannot be compared.
    """
    verdict = compare.check_comparable(params1, params2).first()
    if not verdict["ok"]:
        raise ValueError(verdict["message"])
    key = "star" if cumulative else "hash"
    if cumulative:
        values = compare.compare_cumulative(first, second, value, value)
    else:
        values = compare.compare_service_area(first, second, value or "duration_s")
    return {
        "values": values,
        "only_in_first": compare.only_in_first(first, second, key),
        "only_in_second": compare.only_in_second(first, second, key),
        "parameters": compare.compare_params(params1, params2),
    }
