"""Dense vectors as arrays, bags of words as maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namesmith.functions.text import let


def dot(a: Column, b: Column) -> Column:
    """Dot product; different lengths fail."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NaN with a zero vector."""
    return let(norm(a) * norm(b), lambda n: F.when(n == 0, F.lit(float("nan"))).otherwise(dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n)))


def bag(tokens: Column) -> Column:
    """Token counts as a map<string,double>: tokens are sorted, and where some repeat, each run of equals is counted by where it begins."""

    def counted(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), lambda i: (i < F.size(s)) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        return let(begins, lambda b: F.map_from_arrays(F.transform(b, lambda i: F.get(s, i)), F.transform(b, lambda i, j: (F.coalesce(F.get(b, j + 1), F.size(s)) - i).cast("double"))))

    def once(s: Column) -> Column:
        return F.map_from_arrays(s, F.array_repeat(F.lit(1.0), F.size(s)))

    return let(F.sort_array(tokens), lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), once(s)).otherwise(counted(s)))


def bag_value(bag: Column, key: Column) -> Column:
    return F.coalesce(F.try_element_at(bag, key), F.lit(0.0))


def bag_sum(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def bag_minus(a: Column, b: Column) -> Column:
    """Counts of a less those of b; what reaches zero goes."""
    return F.map_filter(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))), lambda _, v: v != 0)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def bag_dot(a: Column, b: Column) -> Column:
    return total(F.transform(F.map_keys(a), lambda k: bag_value(a, k) * bag_value(b, k)))


def bag_cosine(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    return let(F.sqrt(bag_dot(a, a)) * F.sqrt(bag_dot(b, b)), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(bag_dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n)))


def bag_entropy(a: Column) -> Column:
    """Entropy (natural) over the logarithm of the distinct count; 0 up to one distinct token."""
    values = F.map_values(a)
    raw = lambda n: -total(F.transform(values, lambda v: v / n * F.log(v / n)))
    return F.when(F.size(a) <= 1, F.lit(0.0)).otherwise(let(total(values), raw) / F.log(F.greatest(F.size(a), F.lit(2)).cast("double")))


def size_prior(a: Column) -> Column:
    """Distinct tokens over all."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(a) / F.greatest(total(F.map_values(a)), F.lit(1e-300)))


def saturating(x: Column, weight: float, ceiling: float) -> Column:
    return F.least(F.lit(ceiling), x * weight)
