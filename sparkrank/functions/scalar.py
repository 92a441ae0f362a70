"""Scalar expressions. Missing is NULL everywhere; a NULL operand gives NULL unless a docstring says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def safe_divide(numerator: Column, denominator: Column, least: float = 1e-6) -> Column:
    """The quotient; NULL where the denominator is (nearly) zero or the quotient isn't finite."""
    return finite(F.when(F.abs(denominator) > least, numerator / denominator))


def finite(x: Column) -> Column:
    return F.when((F.abs(x) < INF) & ~F.isnan(x), x)


def log1p_clipped(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def yes_flag(x: Column) -> Column:
    """1 for yes, 1 or true in any case, else 0; a missing flag is not a yes."""
    return F.when(F.lower(x.cast("string")).isin("yes", "1", "true"), 1.0).otherwise(0.0)


def ordinal(x: Column, levels: tuple[str, ...]) -> Column:
    """Place of the level, NULL for any other text."""
    low = F.lower(x.cast("string"))
    return reduce(lambda c, k: c.when(low == levels[k], float(k)), range(1, len(levels)), F.when(low == levels[0], 0.0))


def hundredths(x: Column) -> Column:
    """Hundredths of |x|, half to even."""
    return F.rint(F.abs(x.cast("double")) * 100)


def first_decimal(x: Column) -> Column:
    return F.pmod(F.floor(hundredths(x) / 10), F.lit(10)).cast("int").cast("string")


def decimal_length(x: Column) -> Column:
    return F.when(x.isNotNull(), F.when(hundredths(x) % 10 == 0, "1").otherwise("2"))


def fraction(x: Column) -> Column:
    return F.abs(x) - F.floor(F.abs(x))


def exact_level(x: Column) -> Column:
    """Text of a number, the same whether its column holds whole numbers or not."""
    return x.cast("double").cast("string")


def round_even(x: Column, digits: int) -> Column:
    return F.rint(x * float(10**digits)) / float(10**digits)


def logit(p: Column, clip: float = 1e-6) -> Column:
    p = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip)))
    return F.log(p) - F.log1p(-p)


def sigmoid(z: Column) -> Column:
    """Logistic function that overflows on neither side."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def count_missing(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.isNull().cast("int") for c in columns], F.lit(0))


def missing_pattern(columns: list[Column]) -> Column:
    """Bit k is set if column k is missing."""
    return reduce(lambda a, b: a + b, [c.isNull().cast("long") * F.lit(1 << k).cast("long") for k, c in enumerate(columns)], F.lit(0).cast("long"))


def missing_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 3, "1-3").otherwise("4+")


def any_hidden(hidden: dict[str, Column], sources: dict[str, list[str]]) -> dict[str, Column]:
    """A derived column is hidden if any of the columns that it comes from is."""
    return {name: reduce(lambda a, b: a | b, [hidden[s] for s in own]) for name, own in sources.items()}
