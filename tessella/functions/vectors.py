"""Array expressions over numeric vectors; all of them run inside Spark."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    """Doubles before any arithmetic, so that sums of floats do not round twice."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def superposed(a: Column, b: Column, alpha: Column) -> Column:
    """a + alpha * b."""
    return F.zip_with(a, b, lambda x, y: x + alpha * y)


def quantised(a: Column, scale: float) -> Column:
    """Half-even rounding of ``scale * a`` to whole numbers."""
    return F.transform(a, lambda x: F.rint(x * scale).cast("int"))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x))
    return F.transform(e, lambda x: x / total(e))


def logit(f: Column) -> Column:
    """Logit-normal to normal coordinates: ln(f_i / f_last) for all but the last; a zero is taken as 1e-9."""
    safe = F.transform(f, lambda x: F.greatest(x, F.lit(1e-9)))
    last = F.element_at(safe, -1)
    return F.transform(F.slice(safe, 1, F.size(safe) - 1), lambda x: F.ln(x / last))


def unlogit(n: Column) -> Column:
    """The inverse of ``logit``: one more component, all summing to 1."""
    e = F.concat(F.transform(n, lambda x: F.exp(x)), F.array(F.lit(1.0)))
    return F.transform(e, lambda x: x / total(e))


def mirrored(value: Column, length: Column, reach: int, by: Window) -> list[Column]:
    """``value`` at the 2 * reach + 1 positions around each row of a series; beyond an end the series is mirrored.

    ``length`` is the series' length; a series shorter than the mirror needs gives nulls.
    """
    return [F.coalesce(F.lag(value, -k).over(by), F.lag(value, k).over(by)) for k in range(-reach, reach + 1)]


def geometric_weights(reach: int, centre: float) -> list[float]:
    """Weights c * q**|k| for k in -reach..reach, with c = ``centre`` and q such that they sum to 1."""
    low, high = 0.0, 1.0
    for _ in range(200):
        q = (low + high) / 2
        if centre * (1 + 2 * sum(q**k for k in range(1, reach + 1))) > 1:
            high = q
        else:
            low = q
    return [centre * q ** abs(k) for k in range(-reach, reach + 1)]


def summing_to_one(values: list[float], tolerance: float = 0.1) -> list[float]:
    """Shares corrected so that they sum to 1.

    An error up to 1e-6 goes to the first share that can take it; a larger one is
    spread evenly over the shares above 0, each kept within [0, 1]; one above
    ``tolerance`` raises.
    """
    out, error = list(values), 1.0 - sum(values)
    if abs(error) > tolerance:
        raise ValueError(f"shares sum to {1.0 - error}")
    if abs(error) <= 1e-6:
        for i, v in enumerate(out):
            if v > 0 and 0 <= v + error <= 1:
                out[i] = v + error
                return out
    left = [i for i, v in enumerate(out) if v > 0]
    while left and abs(error) > 1e-15:
        part, error = error / len(left), 0.0
        for i in left:
            new = min(1.0, max(0.0, out[i] + part))
            error += out[i] + part - new
            out[i] = new
        left = [i for i in left if 0 < out[i] < 1]
    return out
