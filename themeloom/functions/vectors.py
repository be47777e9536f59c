"""Vector algebra on array and map columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.functions.special import kl_term


def _fold(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def add(a: Column, b: Column) -> Column:
    """Sum of two arrays."""
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def shift(a: Column, by: Column | float) -> Column:
    """Array plus a scalar."""
    return F.transform(a, lambda x: x + by)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def exponentials(a: Column) -> Column:
    return F.transform(a, F.exp)


def roots(a: Column) -> Column:
    return F.transform(a, F.sqrt)


def total(a: Column) -> Column:
    return _fold(a, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda x: x)


def norm2(a: Column) -> Column:
    """Squared length."""
    return _fold(a, lambda x: x.cast("double") * x.cast("double"))


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def deviation(a: Column) -> Column:
    """Sample standard deviation; null for fewer than two values."""
    m = mean(a)
    return F.when(F.size(a) > 1, F.sqrt(_fold(a, lambda x: (x - m) * (x - m)) / (F.size(a) - 1)))


def first_max(a: Column) -> Column:
    """Struct of the largest value and its first index; null for an empty array."""
    return F.when(F.size(a) > 0, F.struct(F.array_max(a).alias("value"), (F.array_position(a, F.array_max(a)) - 1).cast("int").alias("index")))


def first_min(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.struct(F.array_min(a).alias("value"), (F.array_position(a, F.array_min(a)) - 1).cast("int").alias("index")))


def top_indices(a: Column, k: int) -> Column:
    """Indices of the k largest values, ties to the lower index; at most the array's length."""
    ranked = F.transform(a, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda s: s["i"])


def normalise(a: Column, to: float = 1.0) -> Column:
    """Scaled to a given sum; unchanged if the sum is 0."""
    s = total(a)
    return F.when(s == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x / s * to))


def kl(p: Column, q: Column) -> Column:
    return _fold(F.zip_with(p, q, lambda x, y: kl_term(x, y)), lambda x: x)


def symmetric_kl(p: Column, q: Column) -> Column:
    return (kl(p, q) + kl(q, p)) / 2


def posterior(log_likelihood: Column, prior: Column) -> Column:
    """Prior times exp of log-likelihood, normalised; shifted by the maximum so nothing overflows."""
    top = F.array_max(log_likelihood)
    return normalise(F.zip_with(log_likelihood, prior, lambda x, p: F.exp(x - top) * p))


def direct_posterior(likelihood: Column, prior: Column) -> Column:
    return normalise(hadamard(likelihood, prior))


def fill(n: int, value: float) -> Column:
    return F.array_repeat(F.lit(value), n)


def transpose(rows: Column) -> Column:
    """Transposed array of arrays of equal length."""
    width = F.size(F.get(rows, F.lit(0)))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(rows, lambda r: F.get(r, j))))


def render(a: Column, separator: str = ",", prefix: str = "[", suffix: str = "]", pattern: str | None = None) -> Column:
    """Text such as ``[a,b,]``: the separator also follows the last value."""
    shown = F.transform(a, lambda x: F.concat(F.format_string(pattern, x) if pattern else x.cast("string"), F.lit(separator)))
    return F.concat(F.lit(prefix), F.array_join(shown, ""), F.lit(suffix))


def sparse(a: Column, least: float = 1e-49) -> Column:
    """Struct (dim, idx, val) of the entries with an absolute value above ``least``."""
    kept = F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda s: F.abs(s["v"]) > least)
    return F.struct(F.size(a).alias("dim"), kept["i"].alias("idx"), kept["v"].alias("val"))


def dense(s: Column) -> Column:
    """Array of a sparse struct."""
    entries = F.map_from_arrays(s["idx"], s["val"])
    return F.when(s["dim"] > 0, F.transform(F.sequence(F.lit(0), s["dim"] - 1), lambda i: F.coalesce(F.element_at(entries, i), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))


def sparse_dense_dot(s: Column, a: Column) -> Column:
    return _fold(F.zip_with(s["idx"], s["val"], lambda i, v: v.cast("double") * F.get(a, i).cast("double")), lambda x: x)


def map_add(a: Column, b: Column) -> Column:
    """Key-wise sum; a key in one map only counts 0 in the other."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def map_subtract(a: Column, b: Column) -> Column:
    """Key-wise difference; zero entries stay."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))


def map_scale(a: Column, by: float) -> Column:
    return F.transform_values(a, lambda _, v: v * by)


def map_total(a: Column) -> Column:
    return _fold(F.map_values(a), lambda x: x.cast("double"))


def map_normalise(a: Column, to: float = 1.0) -> Column:
    s = map_total(a)
    return F.transform_values(a, lambda _, v: F.when(s == 0, v.cast("double")).otherwise(v / s * to))


def map_dot(a: Column, b: Column) -> Column:
    return _fold(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0)))), lambda x: x.cast("double"))


def map_kl(p: Column, q: Column) -> Column:
    return _fold(F.map_values(F.map_zip_with(p, q, lambda _, x, y: kl_term(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))), lambda x: x)


def _sparse_of(m: Column, dim: Column) -> Column:
    keys = F.array_sort(F.filter(F.map_keys(m), lambda k: F.element_at(m, k) != 0))
    return F.struct(dim.alias("dim"), keys.alias("idx"), F.transform(keys, lambda k: F.element_at(m, k)).alias("val"))


def _entries(s: Column) -> Column:
    return F.map_from_arrays(s["idx"], s["val"])


def sparse_add(a: Column, b: Column) -> Column:
    """Sum of two sparse structs; entries that cancel out are dropped."""
    return _sparse_of(map_add(_entries(a), _entries(b)), F.greatest(a["dim"], b["dim"]))


def sparse_subtract(a: Column, b: Column) -> Column:
    return _sparse_of(map_subtract(_entries(a), _entries(b)), F.greatest(a["dim"], b["dim"]))


def sparse_scale(s: Column, by: float) -> Column:
    return F.struct(s["dim"].alias("dim"), s["idx"].alias("idx"), F.transform(s["val"], lambda v: v * by).alias("val"))


def sparse_max(s: Column) -> Column:
    """Largest value of a sparse struct, its zeros included; null for dimension 0."""
    stored = F.array_max(s["val"])
    return F.when(F.size(s["idx"]) < s["dim"], F.greatest(F.coalesce(stored, F.lit(0.0)), F.lit(0.0))).otherwise(stored)


def sparse_min(s: Column) -> Column:
    stored = F.array_min(s["val"])
    return F.when(F.size(s["idx"]) < s["dim"], F.least(F.coalesce(stored, F.lit(0.0)), F.lit(0.0))).otherwise(stored)
