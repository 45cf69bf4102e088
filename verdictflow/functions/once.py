"""A column used several times, evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` where the value is evaluated once per row, however often ``then`` uses it.

    Expressions are trees: without this, each use would hold the value's whole expression again.
    """
    return F.transform(F.array(value), then)[0]
