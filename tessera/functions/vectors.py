"""Vector expressions on ``array<float|double>`` columns.

These are the declarative (higher-order function) forms.  Bulk similarity
search uses the Arrow block form in ``operators.search``; these are for
bounded per-row work (e.g. a candidate against a handful of selected items).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Inner product accumulated in double."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, x: s + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0).cast("double"),
                              lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v, as_float: bool = True) -> Column:
    """v / ||v||; a zero vector stays zero."""
    n = l2_norm(v)
    t = "float" if as_float else "double"
    return F.transform(_c(v), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n).cast(t))
