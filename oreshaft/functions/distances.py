"""Distances between distributions held as equally long arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _half_kl(p: Column, m: Column) -> Column:
    return total(F.zip_with(p, m, lambda x, y: F.when(x > 0, x * F.log2(x / y)).otherwise(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the base 2 Jensen-Shannon divergence, which is floored at 0."""
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), (_half_kl(p, m) + _half_kl(q, m)) / 2))


def js_divergence(p: Column, q: Column) -> Column:
    """Base 2 Jensen-Shannon divergence of p and q, each with TINY added and normalised again."""

    def eased(a: Column) -> Column:
        return F.transform(a, lambda x: (x + TINY) / (total(a) + TINY * F.size(a)))

    a, b = eased(p), eased(q)
    m = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    return (_half_kl(a, m) + _half_kl(b, m)) / 2


def chi2(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: (x - y) * (x - y) / (x + y + TINY))) / 2


def cosine(p: Column, q: Column) -> Column:
    norm = lambda a: F.sqrt(total(F.transform(a, lambda x: x * x)))
    return total(F.zip_with(p, q, lambda x, y: x * y)) / (norm(p) * norm(q) + TINY)


def sorted_cosine(p: Column, q: Column) -> Column:
    """Cosine of the sorted values: blind to which byte is which."""
    return cosine(F.array_sort(p), F.array_sort(q))


def entropy(n: Column, total_n: Column) -> Column:
    """A count's share in the Shannon entropy (bits) of its bag; sum it over the bag."""
    p = n / total_n
    return -p * F.log2(p)
