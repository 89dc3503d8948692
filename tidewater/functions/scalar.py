"""Scalar functions of the feature language. What isn't a number counts as 0."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.syntax import FeatureError

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(value: Column) -> Column:
    """The value as a double if it is one or is written as one, else null."""
    text = value.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _or_zero(value: Column) -> Column:
    return F.coalesce(number(value), F.lit(0.0))


def _divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, math.nan).otherwise(F.try_divide(a, b))


def _log(a: Column) -> Column:
    return F.when(a > 0, F.ln(a)).when(a == 0, -math.inf).otherwise(math.nan)


#: name -> (least and most arguments, function of doubles)
SCALARS: dict[str, tuple[int, int | None, Callable[..., Column]]] = {
    "F_SUM": (1, None, lambda *a: sum(a[1:], a[0])),
    "F_ADD": (2, 2, lambda a, b: a + b),
    "F_MINUS": (2, 2, lambda a, b: a - b),
    "F_MULTIPLY": (2, 2, lambda a, b: a * b),
    "F_DIVIDE": (2, 2, _divide),
    "F_POW": (2, 2, F.pow),
    "F_SQRT": (1, 1, F.sqrt),
    "F_EXP": (1, 1, F.exp),
    "F_LOG": (1, 1, _log),
    "F_ABS": (1, 1, F.abs),
}


def scalar(op: str, args: list[Column]) -> Column:
    least, most, make = SCALARS[op]
    if len(args) < least or most is not None and len(args) > most:
        raise FeatureError(f"{op} takes {least if least == most else f'{least} or more'} arguments, not {len(args)}")
    return make(*map(_or_zero, args))


def register_scalar(name: str, least: int, most: int | None, make: Callable[..., Column]) -> None:
    """A scalar function of one's own: make takes and gives columns of doubles. Its name begins with F_ and is new."""
    if not name.startswith("F_") or name != name.upper() or name in SCALARS or name in ("F_GET", "F_QUANTILE"):
        raise FeatureError(f"not a new name of a scalar function: {name}")
    SCALARS[name] = (least, most, make)
