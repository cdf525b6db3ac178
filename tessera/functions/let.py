"""Values that an expression uses many times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row: a lambda's variable is not inlined,
    so expressions that use it often stay small."""
    return F.element_at(F.transform(F.array(value), body), 1)
