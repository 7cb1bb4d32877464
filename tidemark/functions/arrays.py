"""Functions over numeric arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a, b) -> Column:
    return total(F.zip_with(c(a), c(b), lambda x, y: x * y))


def cosine(a, b) -> Column:
    """null if either vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def unit(a) -> Column:
    return let(F.sqrt(dot(a, a)), lambda norm: F.transform(c(a), lambda x: F.try_divide(x, norm)))


def centred(a) -> Column:
    return let(total(c(a)) / F.size(c(a)), lambda mean: F.transform(c(a), lambda x: x - mean))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: lambdas don't share their subexpressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _distortion(prediction, target, epsilon: float, scaled: bool) -> Column:
    both = F.struct(centred(prediction).alias("p"), centred(target).alias("t"))

    def ratio(v):
        noise = total(F.zip_with(v["p"], v["t"], lambda x, y: (x - (v["a"] * y if scaled else y)) * (x - (v["a"] * y if scaled else y))))
        return 10 * F.log10((v["a"] * v["a"] * v["tt"] + epsilon) / (noise + epsilon))

    def scale(v):
        energy = dot(v["t"], v["t"])
        return let(F.struct(v["p"].alias("p"), v["t"].alias("t"), energy.alias("tt"), (dot(v["p"], v["t"]) / (energy + epsilon)).alias("a")), ratio)

    return let(both, scale)


def si_sdr(prediction, target, epsilon: float = 1e-8) -> Column:
    """M1: scale-invariant signal-to-distortion ratio in dB of zero-mean vectors."""
    return _distortion(prediction, target, epsilon, True)


def sd_sdr(prediction, target, epsilon: float = 1e-8) -> Column:
    """M2: scale-dependent signal-to-distortion ratio in dB of zero-mean vectors."""
    return _distortion(prediction, target, epsilon, False)


def rms_db(a, epsilon: float = 1e-12) -> Column:
    """Root mean square in dB of full scale."""
    return 20 * F.log10(F.greatest(F.sqrt(dot(a, a) / F.size(c(a))), F.lit(epsilon)))


def peak_db(a, epsilon: float = 1e-12) -> Column:
    return 20 * F.log10(F.greatest(F.array_max(F.transform(c(a), F.abs)), F.lit(epsilon)))


def sliding(a, window: int, hop: int) -> Column:
    """Windows of fixed length; a shorter array is padded with zeros to one window."""
    full = F.when(F.size(c(a)) < window, F.concat(c(a), F.array_repeat(F.lit(0.0), F.lit(window) - F.size(c(a))))).otherwise(c(a))
    return F.transform(F.sequence(F.lit(0), F.size(full) - window, F.lit(hop)), lambda i: F.slice(full, i + 1, F.lit(window)))


def sorted_distinct(a) -> Column:
    """F22."""
    return F.array_sort(F.array_distinct(c(a)))
