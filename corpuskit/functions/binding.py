"""Names for values within expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    Without it, an expression used inside a lambda is computed again for every element the lambda sees.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
