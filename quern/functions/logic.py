"""Predicates of two-valued logic: a comparison with null is true or false, never unknown."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def col(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def holds(p: Column) -> Column:
    """A predicate that is unknown does not hold."""
    return F.coalesce(p, F.lit(False))


def eq(a: Any, b: Any) -> Column:
    return col(a).eqNullSafe(col(b))


def ne(a: Any, b: Any) -> Column:
    return ~eq(a, b)


def lt(a: Any, b: Any) -> Column:
    return holds(col(a) < col(b))


def le(a: Any, b: Any) -> Column:
    return holds(col(a) <= col(b))


def gt(a: Any, b: Any) -> Column:
    return holds(col(a) > col(b))


def ge(a: Any, b: Any) -> Column:
    return holds(col(a) >= col(b))


def all_of(*p: Column) -> Column:
    return reduce(lambda x, y: x & y, map(holds, p), F.lit(True))


def any_of(*p: Column) -> Column:
    """An empty alternative holds nowhere."""
    return reduce(lambda x, y: x | y, map(holds, p), F.lit(False))


def negate(p: Column) -> Column:
    return ~holds(p)


def divide(a: Any, b: Any, whole: bool) -> Column:
    """Division; of whole numbers it truncates toward zero."""
    return F.call_function("div", col(a), col(b)) if whole else col(a) / col(b)


def in_range(value: Column, start: Any, end: Any) -> Column:
    """Both ends belong to the range."""
    return holds(value.between(col(start), col(end)))


def overlaps(start: Column, end: Column, from_: Any, to: Any) -> Column:
    return holds((start <= col(to)) & (end >= col(from_)))


def _ordinal(comparison: str) -> None:
    if comparison != "ordinal":
        raise ValueError(f"only ordinal string comparison is supported, not {comparison!r}")


def starts_with(value: Column, prefix: str, comparison: str = "ordinal") -> Column:
    _ordinal(comparison)
    return holds(value.startswith(prefix))


def contains(value: Column, part: str, comparison: str = "ordinal") -> Column:
    _ordinal(comparison)
    return holds(value.contains(part))


def _fits(value: Any, kind: T.DataType) -> Any:
    """`value` as an element of the kind, or None if something would be lost."""
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else None
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        return None
    if isinstance(kind, INTEGRAL):
        return int(number) if number == number.to_integral_value() else None
    return float(number)


def has_element(array: Column, kind: T.ArrayType, value: Any) -> Column:
    """Whether an array has an element equal to a value after a conversion without loss; a lossy one never matches."""
    fitted = _fits(value, kind.elementType)
    return F.lit(False) if fitted is None else holds(F.array_contains(array, F.lit(fitted).cast(kind.elementType)))


def one_of(value: Column, values: Iterable[Any]) -> Column:
    """Membership; nulls in the list are skipped, an empty list has no members."""
    held = [v for v in values if v is not None]
    return holds(value.isin(held)) if held else F.lit(False)
