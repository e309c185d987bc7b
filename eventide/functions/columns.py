"""Column expressions: paths, numbers, kernels, vectors and nulls."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1)


def interval_text(intervals: Column) -> Column:
    """[{b, e}, ...] as "b-e, b-e" with two decimals."""
    return F.array_join(F.transform(intervals, lambda x: F.format_string("%.2f-%.2f", x["b"], x["e"])), ", ")


def gaussian(x: Column, mean: Column | float, std: Column | float) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / std, F.lit(2)))


def logistic(t: Column) -> Column:
    return 1 / (1 + F.exp(-t))


def truncated(x: Column) -> Column:
    """Towards zero."""
    return x.cast("bigint")


def log10(x: Column) -> Column:
    """The decimal logarithm as floating-point numbers have it: of zero -Infinity, of what lies below NaN (Spark's own is null for both)."""
    x = x.cast("double")
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(F.log10(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def finite(x: Column, bound: float) -> Column:
    """NaN as 0, infinities and what lies beyond as the bound."""
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(clamp(x, -bound, bound))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)


def index_of_max(a: Column) -> Column:
    """Place (from 0) of the first largest element."""
    return F.array_position(a, F.array_max(a)) - 1


def rms(a: Column) -> Column:
    return norm(a) / F.sqrt(F.size(a))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once and not for every element that body goes over."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scaled(a: Column, divisor) -> Column:
    """x - mean, divided by divisor(std)."""
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)
    by = lambda c: let(divisor(rms(c)), lambda d: F.transform(c, lambda x: x / d))
    return let(mean, lambda m: let(F.transform(a, lambda x: x.cast("double") - m), by))


def to_rms(a: Column, target: float) -> Column:
    """(x - mean) / max(std / target, 1e-6) of a signal."""
    return scaled(a, lambda std: F.greatest(std / target, F.lit(1e-6)))


def ramped(a: Column, length: int) -> Column:
    """Linear fade in over the first `length` samples and fade out over the last."""
    n = F.size(a)
    return F.transform(a, lambda x, i: x.cast("double") * F.least(F.lit(1.0), i / length, (n - 1 - i) / length))


def wrapped(a: Column, chunk: int) -> Column:
    """A signal repeated from its start on until its length is a multiple of chunk."""
    n = F.size(a)
    missing = F.pmod(-n, F.lit(chunk))
    more = F.transform(F.sequence(F.lit(0), F.greatest(missing - 1, F.lit(0))), lambda i: F.element_at(a, F.pmod(i, n) + 1))
    return F.concat(a, F.slice(more, 1, missing))


def zero_padded(a: Column, chunk: int) -> Column:
    """A signal followed by zeros until its length is a multiple of chunk."""
    return F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), F.pmod(-F.size(a), F.lit(chunk))))


def padded_by(a: Column, length: int) -> Column:
    """Zeros before and behind a signal."""
    return F.concat(F.array_repeat(F.lit(0.0), length), F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), length))


def central(a: Column, length: int) -> Column:
    """The middle `length` elements; all if there are fewer."""
    return F.slice(a, F.greatest(F.lit(1), F.floor((F.size(a) - length) / 2).cast("int") + 1), length)


def sized(a: Column, length: int) -> Column:
    """Cut, or padded with zeros, to a length."""
    return F.slice(F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), length)), 1, length)


def crop(a: Column, start: Column, length: int) -> Column:
    """`length` elements from start (from 0) on."""
    return F.slice(a, (start + 1).cast("int"), length)


def stitched(a: Column, length: int, pieces: int, gap: int = 100) -> Column:
    """Pieces of a signal with `gap` samples left out between them, one after another: together no longer than length
    with the gaps."""
    size = (length - gap * (pieces - 1)) // pieces
    return F.concat(*(F.slice(a, i * (size + gap) + 1, size) for i in range(pieces)))


def tiled(a: Column, length: int) -> Column:
    """A signal repeated until it has `length` samples."""
    times = F.ceil(F.lit(length) / F.greatest(F.size(a), F.lit(1))).cast("int")
    return F.slice(F.flatten(F.array_repeat(a, times)), 1, length)


def at_speed(a: Column, factor: float) -> Column:
    """A signal played `factor` times as fast (and as high): between samples by straight lines."""
    last = F.size(a) - 1
    count = F.greatest(F.floor(F.size(a) / factor).cast("int"), F.lit(1))

    def sample(i: Column) -> Column:
        low = F.floor(i * factor).cast("int")
        part = i * factor - low
        return F.get(a, F.least(low, last)).cast("double") * (1 - part) + F.get(a, F.least(low + 1, last)).cast("double") * part

    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), count - 1), sample)).otherwise(F.array().cast("array<double>"))


def normalised(a: Column, least: float = 1e-6) -> Column:
    """(x - mean) / max(std, least)."""
    return scaled(a, lambda std: F.greatest(std, F.lit(least)))


def noisy(a: Column, key: Column, scale: float) -> Column:
    """A signal with normal noise of a standard deviation; the noise depends on key and place only."""
    uniform = lambda i, salt: (F.pmod(key * 2654435761 + (i + salt) * 40503, F.lit(9973)) + 0.5) / 9973
    return F.transform(a, lambda x, i: x.cast("double") + scale * F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * math.pi * uniform(i, 5000)))


def mixed_at_snr(foreground: Column, background: Column, snr_db: float) -> Column:
    """background + foreground scaled to rms(background) / rms(foreground) * 10^(0.1 snr)."""
    gain = F.try_divide(rms(background), rms(foreground)) * (10 ** (0.1 * snr_db))
    return let(gain, lambda g: F.zip_with(foreground, background, lambda x, y: x.cast("double") * g + y.cast("double")))
