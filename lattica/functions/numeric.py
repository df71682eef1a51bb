"""Numbers, arrays as vectors, and similarity kernels as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    x = F.greatest(x, F.lit(low)) if low is not None else x
    return F.least(x, F.lit(high)) if high is not None else x


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / (2 * F.pi()) ** 0.5


# The polynomial of Abramowitz and Stegun, 26.2.17.
_P = 0.2316419
_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, within 7.5e-8."""
    t = 1 / (1 + _P * F.abs(x))
    tail = normal_density(x) * reduce(lambda s, b: (s + b) * t, reversed(_B), F.lit(0.0))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def mills(x: Column) -> Column:
    """v: density over distribution function."""
    return normal_density(x) / normal_cdf(x)


def mills_slope(x: Column) -> Column:
    """w = v * (v + x)."""
    return mills(x) * (mills(x) + x)


# arrays of doubles


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dot3(a: Column, b: Column, c: Column) -> Column:
    return dot(times(a, b), c)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scaled(a: Column, k: Column | float) -> Column:
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(a, lambda x: x * k)


def head(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def tail(a: Column, n: int) -> Column:
    return F.slice(a, -n, n)


def mid(a: Column, start: int, n: int) -> Column:
    return F.slice(a, start + 1, n)


def sort_index(a: Column) -> Column:
    """Places (from 0) of the elements in ascending order."""
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def running_sum(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0.0), lambda s, x: s + x))


def sum_arrays(column: str, size: int) -> Column:
    """Aggregate: the element-wise sum of arrays of a known size, combined before the shuffle."""
    return F.array(*[F.sum(F.col(column)[k]) for k in range(size)])


# maps as sparse vectors


def sparse_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))


def sparse_sum_squares(a: Column) -> Column:
    return F.aggregate(F.map_values(a), F.lit(0.0), lambda s, x: s + x * x)


def sparse_minus(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))


# similarity kernels over sums


def jaccard(common: Column, a: Column, b: Column) -> Column:
    return common / (a + b - common)


def cosine(xy: Column, xx: Column, yy: Column) -> Column:
    return xy / F.sqrt(xx * yy)


def tanimoto(xy: Column, xx: Column, yy: Column) -> Column:
    return xy / (xx + yy - xy)


def log_likelihood(common: Column, a: Column, b: Column, everyone: Column) -> Column:
    """Dunning's ratio for two sets of sizes a and b among `everyone`, `common` of them in both."""
    h = lambda *ks: sum((F.when(k > 0, -k * F.log(k / everyone)).otherwise(0.0) for k in ks), F.lit(0.0))
    rows, columns = h(a, everyone - a), h(b, everyone - b)
    cells = h(common, a - common, b - common, everyone - a - b + common)
    return F.greatest(F.lit(0.0), 2 * (rows + columns - cells))


def coin(id: Column, a: int, b: int) -> Column:
    """0 or 1 for an id, for contracting stars."""
    return ((a * id + b) % 7907) % 2


def draw(seed: int | str, *parts: Column | str) -> Column:
    """A number in [0, 1) from the first 40 bits of the MD5 of seed:part:part..., which any SQL engine can repeat."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("long") / float(1 << 40)


def euclidean(xx: Column, yy: Column, xy: Column) -> Column:
    """Distance of two vectors from their sums of squares and products."""
    return F.sqrt(F.greatest(F.lit(0.0), xx + yy - 2 * xy))


# sparse vectors: further operations


def sparse_count(a: Column) -> Column:
    """How many entries are not 0."""
    return F.size(F.map_filter(a, lambda _, x: x != 0))


def sparse_abs(a: Column) -> Column:
    return F.transform_values(a, lambda _, x: F.abs(x))


def sparse_times(a: Column, b: Column) -> Column:
    """The element-wise product, on the entries that both have."""
    return F.map_filter(F.map_zip_with(a, b, lambda _, x, y: x * y), lambda _, x: x.isNotNull())


def sparse_set(a: Column, key: Column, value: Column) -> Column:
    """a with one entry set."""
    return F.map_concat(F.map_filter(a, lambda k, _: k != key), F.create_map(key, value))
