"""Vector functions as column expressions over array<float> or array<double>; sums are in double.

`F.aggregate(F.zip_with(...))` stays in the JVM; a value that several elements need is bound once, as
the only element of an array (see `_let`), because a lambda's body is evaluated per element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if either side is null or the lengths differ by a null element."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """a at length 1, as array<double>; an error for a zero vector, null for null."""
    zero = F.raise_error(F.lit("cannot normalise a zero vector")).cast("array<double>")
    return F.when(a.isNotNull(), _let(norm(a), lambda n: F.when(n == 0, zero).otherwise(F.transform(a, lambda x: x.cast("double") / n))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 if either vector is zero."""
    return _let(norm(a) * norm(b), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def mean_squared_error(a: Column, b: Column) -> Column:
    return squared_distance(a, b) / F.size(a)


def scaled(a: Column, by: float | Column) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(a, lambda x: x.cast("double") * by)


def action_key(z: Column, action: Column | None, scale: float) -> Column:
    """The key that a row is indexed under: z, or z and the scaled action as one vector, at length 1.

    A row without an action has the key of z alone (of z's length), whatever the scale."""
    if action is None:
        return normalize(z)
    return normalize(F.when(action.isNull(), F.transform(z, lambda x: x.cast("double"))).otherwise(F.concat(F.transform(z, lambda x: x.cast("double")), scaled(action, scale))))


def mix(a: Column, b: Column, alpha: float) -> Column:
    """(1 - alpha) a + alpha b, element by element."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") * (1.0 - alpha) + y.cast("double") * alpha)


def depth_decay(depth: Column) -> Column:
    return F.pow(F.lit(0.5), depth)


def time_decay(now_ns: int | Column, last_ns: Column, constant_s: float) -> Column:
    """exp(-age / constant), age in seconds and never below 0."""
    now = now_ns if isinstance(now_ns, Column) else F.lit(now_ns)
    return F.exp(-F.greatest(F.lit(0.0), (now - last_ns) / F.lit(1e9)) / F.lit(float(constant_s)))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """value between low and high as 0 to 1; 0.5 where they are equal."""
    return F.when(high == low, F.lit(0.5)).otherwise((value - low) / (high - low))


def checked_length(a: Column, n: int, what: str) -> Column:
    """a, or an error if it isn't null and doesn't have n elements."""
    wrong = F.raise_error(F.concat(F.lit(f"{what} must have {n} elements, not "), F.size(a).cast("string")))
    return F.when(a.isNull() | (F.size(a) == n), a).otherwise(wrong.cast("array<float>"))
