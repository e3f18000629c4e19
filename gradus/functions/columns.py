"""Column functions shared by the operators: rounding, vectors, logistic and memory formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Rounded to six places, halves up, in double arithmetic alone (so that another engine can repeat it)."""
    return F.floor(c.cast("double") * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one of them has length 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def usable(v: Column, dims: int) -> Column:
    """Whether v has ``dims`` finite numbers that are not all 0; false for null."""
    inf = float("inf")
    good = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def direction_feature(u: Column, v: Column) -> Column:
    """u, v, u - v and u * v (by element) in one array."""
    u, v = doubles(u), doubles(v)
    return F.concat(u, v, F.zip_with(u, v, lambda x, y: x - y), F.zip_with(u, v, lambda x, y: x * y))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p: Column, eps: float = 1e-9) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(p / (1 - p))


def blend(score: Column, asymmetry: Column, alpha: float = 0.5) -> Column:
    """Score moved on the logit scale by ``alpha`` times the asymmetry, kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sigmoid(logit(score) + F.lit(alpha) * asymmetry)))


def spatial_sign(x: Column) -> Column:
    return x / (F.lit(1e-9) + F.abs(x))


def difficulty_prior(accuracy: Column) -> Column:
    """First stability in seconds of a concept that this share of learners answers right at once: half a day to three days."""
    return (F.lit(0.5) + F.lit(2.5) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), accuracy))) * 86400.0


def retention(seconds: Column, stability: Column) -> Column:
    """Forgetting curve: share kept after ``seconds`` at a stability in seconds."""
    return F.exp(-seconds.cast("double") / stability.cast("double"))


def decay_time(stability: Column, threshold: Column) -> Column:
    """Seconds until retention falls to the threshold; null outside 0 < threshold < 1."""
    return F.when((threshold > 0) & (threshold < 1), stability * F.log(1 / threshold))
