"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once; a literal so bound stands in the plan once."""
    return F.get(F.transform(F.array(value), body), 0)
