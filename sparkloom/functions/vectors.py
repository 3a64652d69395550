"""Vector arithmetic as higher-order column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str, mismatch: str = "zero", floor: float = 0.0) -> Column:
    """Cosine similarity.

    Vectors of different lengths give 0, or with ``mismatch="prefix"`` are
    compared over the shorter length; a norm at or below ``floor`` gives 0.
    """
    a, b = _col(a), _col(b)
    if mismatch == "prefix":
        n = F.least(F.size(a), F.size(b))
        a, b = F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0)))
    na, nb = norm(a), norm(b)
    sound = (F.size(a) == F.size(b)) & (na > floor) & (nb > floor)
    return F.coalesce(F.when(sound, F.try_divide(dot(a, b), na * nb)), F.lit(0.0))
