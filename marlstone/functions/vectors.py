"""Vector arithmetic on array columns, in double, inside whole-stage plans."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """With EPS in each norm; norms may be given, so that one side's is computed once a row."""
    return dot(a, b) / (((norm(a) if na is None else na) + EPS) * ((norm(b) if nb is None else nb) + EPS))


def unit(a: Column, floor: float | None = None) -> Column:
    """a / |a|; a zero norm counts as one, or as ``floor`` at least where given."""
    n = norm(a)
    n = F.greatest(n, F.lit(floor)) if floor else F.when(n == 0, 1.0).otherwise(n)
    return F.transform(a, lambda x: x.cast("double") / n)


def dist2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
