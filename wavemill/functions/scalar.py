"""Column expressions for snippets (array columns), geometry and labels. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def peak_to_peak(a) -> Column:
    """Maximum less minimum; nulls and NaN are ignored."""
    clean = F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.array_max(clean) - F.array_min(clean)


def trough(a) -> Column:
    return F.array_min(a)


def signed_extreme(a) -> Column:
    """The value of largest magnitude with its sign; the first on ties."""
    col = F.col(a) if isinstance(a, str) else a
    top = F.array_max(F.transform(col, F.abs))
    return F.get(F.filter(col, lambda x: F.abs(x) == top), F.lit(0))


def argmax(a) -> Column:
    """Place of the first maximum, counted from 0."""
    col = F.col(a) if isinstance(a, str) else a
    return F.array_position(col, F.array_max(col)) - 1


def argmin(a) -> Column:
    col = F.col(a) if isinstance(a, str) else a
    return F.array_position(col, F.array_min(col)) - 1


def peak_trough_lag(a) -> Column:
    return F.abs(argmax(a) - argmin(a))


def peak_trough_log_ratio(a) -> Column:
    return F.log(-F.array_max(a) / F.array_min(a))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def max_abs_difference(a, b) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def shifted(a, k: int, size: int) -> Column:
    """The array moved k places to the right (left if k < 0), zeros where nothing moves in."""
    col = F.col(a) if isinstance(a, str) else a
    zeros = F.array_repeat(F.lit(0.0), abs(k))
    body = col.cast("array<double>")
    if not k:
        return body
    return F.concat(zeros, F.slice(body, 1, size - k)) if k > 0 else F.concat(F.slice(body, 1 - k, size + k), zeros)


def rolled(a, k: Column) -> Column:
    """The array moved k places to the left (right if k < 0), per row; what moves in is a linear ramp from the end value to 0."""
    col = (F.col(a) if isinstance(a, str) else a).cast("array<double>")
    n = F.size(col)
    inside = lambda i: F.get(col, i + k)
    ramp = lambda i: F.when(i + k < 0, F.get(col, F.lit(0)) * i / -k).when(i + k >= n, F.get(col, n - 1) * (n - 1 - i) / k)
    return F.transform(col, lambda v, i: F.when((i + k < 0) | (i + k >= n), ramp(i)).otherwise(inside(i)))


def shift_distance(a, b, shifts: range, size: int) -> Column:
    """Least over shifts of the largest absolute difference."""
    return F.least(*[max_abs_difference(shifted(a, k, size), b) for k in shifts]) if len(shifts) > 1 else max_abs_difference(shifted(a, shifts[0], size), b)


def gather(a, places) -> Column:
    """Elements at places; null beyond the array."""
    col = F.col(a) if isinstance(a, str) else a
    return F.transform(places, lambda i: F.get(col, i))


def point_source(alpha, dx, dy, dz, squared: bool = False) -> Column:
    """Amplitude of a point source; ``squared`` divides by the squared distance."""
    d2 = dx * dx + dy * dy + dz * dz
    return alpha / (d2 if squared else F.sqrt(d2))


def logistic_weight(height, snr, a: float = 12.0, b: float = 12.0, d: float = 6.0, ceiling: float = 3.0) -> Column:
    return 1 / (1 + F.exp(d + a * height - b * F.least(snr, F.lit(ceiling)) / ceiling))


def outward_monotone(a) -> Column:
    """Running minimum of magnitudes from the front; signs stay."""
    col = F.col(a) if isinstance(a, str) else a
    start = F.struct(F.lit(float("inf")).alias("m"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        m = F.least(s["m"], F.abs(x.cast("double")))
        return F.struct(m.alias("m"), F.concat(s["out"], F.array(F.signum(x) * m)).alias("out"))

    return F.aggregate(col, start, step, lambda s: s["out"])


def temporal_decrease(a, left: int, right: int) -> Column:
    """Magnitudes that don't grow outward: running minimum from place ``left`` to the front and from ``right`` to the end; signs stay."""
    col = F.col(a) if isinstance(a, str) else a
    front = F.reverse(outward_monotone(F.reverse(F.slice(col, 1, left + 1))))
    between = F.slice(col, left + 2, right - left - 1).cast("array<double>")
    back = outward_monotone(F.slice(col, F.lit(right + 1), F.greatest(F.size(col) - right, F.lit(0))))
    return F.concat(front, between, back)


def clean_name(name) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")


def up_down(n) -> Column:
    """1, 2, .., up and down again, n entries."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.least(i, n + 1 - i))


def cubic_weights(f) -> list[Column]:
    """Weights of the samples at -1, 0, 1 and 2 in cubic convolution (a = -1/2), at fraction f between 0 and 1."""
    return [((-0.5 * f + 1) * f - 0.5) * f, (1.5 * f - 2.5) * f * f + 1, ((-1.5 * f + 2) * f + 0.5) * f, (0.5 * f - 0.5) * f * f]
