"""Checks of streams: validation keeps no state; rates of conformance are windowed by event time."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.validate import validate
from ..sources.contract import Contract


def validate_stream(stream: DataFrame, column: str, schema: Any, contract: Contract | None = None) -> DataFrame:
    return validate(stream, column, schema, contract)


def conformance_rate(checked: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes", *by: str) -> DataFrame:
    """(window, by, n_rows, n_valid) of a stream or table with ``valid``; rows later than ``late`` are dropped by streams."""
    timed = checked.withWatermark(time, late) if checked.isStreaming else checked
    return timed.groupBy(F.window(time, window), *by).agg(F.count("*").alias("n_rows"), F.count_if("valid").alias("n_valid"))
