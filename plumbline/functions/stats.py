"""Statistics that Spark's own functions leave undefined or refuse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import col


def corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over the rows where both are present; null where one of them does not vary there."""
    a, b = (col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = F.when(b.isNotNull(), a).cast("double"), F.when(a.isNotNull(), b).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
