"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(
    a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None, strict: bool = False
) -> Column:
    """Cosine similarity; 0.0 where a vector has no length, null where sizes differ or are zero (an error if ``strict``).

    Pass norms computed once per row when a vector takes part in several pairs.
    """
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    comparable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    score = F.when(comparable, F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb)))
    if strict:
        failed = F.raise_error(F.lit("vectors differ in size or are empty")).cast("double")
        score = score.when(a.isNotNull() & b.isNotNull(), failed)
    return score
