"""Column expressions shared by the operators.

Missing-value policy: one missing state, NULL. NaN and infinities are turned
into NULL at the edges (``finite_or_null``) and divisions by zero give NULL
(``ratio``), so later steps only ever test for NULL.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """True for a usable number; False for NULL, NaN and +-Inf."""
    # NaN sorts above every number in Spark, so one comparison rejects NaN and Inf.
    return F.coalesce(F.abs(as_col(c).cast("double")) < F.lit(INFINITY), F.lit(False))


def all_finite(cols: Sequence[str | Column]) -> Column:
    return reduce(and_, [is_finite(c) for c in cols], F.lit(True))


def finite_or_null(c: str | Column) -> Column:
    return F.when(is_finite(c), as_col(c))


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when the denominator is zero or the result is not finite."""
    return finite_or_null(F.try_divide(as_col(num).cast("double"), as_col(den).cast("double")))


def row_sum(cols: Iterable[str | Column]) -> Column:
    """Sum across columns of one row; NULL as soon as one term is NULL."""
    return reduce(add, [as_col(c) for c in cols])


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def dot(cols: Sequence[str | Column], factors: Sequence[str | Column]) -> Column:
    return reduce(add, [as_col(c) * as_col(f) for c, f in zip(cols, factors, strict=True)])


def round_even(c: str | Column, digits: int) -> Column:
    """Round half to even."""
    return F.bround(as_col(c), digits)


def number_text(c: str | Column, digits: int) -> Column:
    """A rounded number as text without trailing zeros: 2.50 -> '2.5', 3.00 -> '3'."""
    fixed = round_even(c, digits).try_cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(fixed, r"\.?0+$", "") if digits > 0 else fixed


def bracketed(c: str | Column, digits: int) -> Column:
    return F.concat(F.lit("("), number_text(c, digits), F.lit(")"))


def significance_stars(p: str | Column) -> Column:
    p = as_col(p)
    return (
        F.when(p <= 0.01, "***").when(p <= 0.05, "**").when(p <= 0.1, "*").otherwise("")
    )


def strip_markup(c: str | Column) -> Column:
    """Drop the markup signs $ ^ { } * ( ) from a label, leaving the number."""
    return F.regexp_replace(as_col(c), r"[$^{}*()]", "")


def dots_to_spaces(c: str | Column) -> Column:
    return F.replace(as_col(c), F.lit("."), F.lit(" "))
