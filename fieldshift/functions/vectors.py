"""Array-valued vector expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Inside a higher-order function an outer expression is evaluated again for
    every element; binding it to a lambda variable avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def unit_length(a: Column, floor: float = 1e-8) -> Column:
    """Scale to length one; a vector shorter than ``floor`` is left as it is."""
    return let(norm(a), lambda n: F.transform(a, lambda x: x / F.when(n < floor, F.lit(1.0)).otherwise(n)))


def standardized(a: Column, mean: Column, std: Column) -> Column:
    centred = F.zip_with(a, mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / s)


def mean_vector(vec: Column, weight: Column | None = None) -> Column:
    """Aggregate: element-wise mean, partially aggregated before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_double(vec)), weight))


def double_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
