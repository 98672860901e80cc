"""Property filters as Spark columns.

A filter maps property names to a value or to operators on it, all of which must hold:
``{"age": {"gte": 18, "lt": 65}, "city": "Rome"}``.  Operators may be written with or without a
leading ``$``.  Values are compared strictly: a value never equals one of another type.

A null and a missing property are the same in typed columns.  Both fail every operator but
``neq``, ``exists: False``, equality with null and membership in a list that holds null; ``neq``
holds for them.  An unknown operator is an error.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "contains", "startsWith", "endsWith", "exists")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def never() -> Column:
    return F.lit(False)


def always() -> Column:
    return F.lit(True)


class UnknownOperator(ValueError):
    """A filter names an operator that doesn't exist."""


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _kind(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float, Decimal)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (dt.datetime, dt.date)):
        return "time"
    if isinstance(value, (list, tuple)):
        return "array"
    raise ValueError(f"{value!r} can't be compared with a property")


def _kind_of(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, NUMERIC):
        return "number"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "array" if isinstance(kind, T.ArrayType) else type(kind).__name__


class Property:
    """A property as a column that can be compared with a Python value of any type."""

    def __init__(self, column: Column, kind: T.DataType) -> None:
        self.column, self.kind = column, kind
        self.dynamic = isinstance(kind, T.VariantType)

    def missing(self) -> Column:
        return F.coalesce(F.is_variant_null(self.column), always()) if self.dynamic else self.column.isNull()

    def typed(self, value: Any) -> Column | None:
        """The column as the value's type, null where it has another; None if it always has."""
        kind = _kind(value)
        if not self.dynamic:
            return self.column if _kind_of(self.kind) == kind else None
        spelt = F.schema_of_variant(self.column)
        if kind == "number":
            return F.when(spelt.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(self.column, "$", "double"))
        if kind == "string":
            return F.when(spelt == "STRING", F.try_variant_get(self.column, "$", "string"))
        if kind == "boolean":
            return F.when(spelt == "BOOLEAN", F.try_variant_get(self.column, "$", "boolean"))
        return None

    def text(self) -> Column:
        return F.try_variant_get(self.column, "$", "string") if self.dynamic else self.column.cast("string")

    def literal(self, value: Any) -> Column:
        if isinstance(value, (list, tuple)):
            return F.array(*[F.lit(v) for v in value])
        return F.lit(value)

    def compared(self, value: Any, how: str) -> Column:
        """May be null where the property is: in a filter that is as good as false, and it reaches the scan."""
        if value is None:
            return self.missing() if how == "eq" else never()
        column = self.typed(value)
        if column is None:
            return never()
        other = self.literal(value)
        return {
            "eq": lambda: column == other,
            "gt": lambda: column > other,
            "gte": lambda: column >= other,
            "lt": lambda: column < other,
            "lte": lambda: column <= other,
        }[how]()

    def among(self, values: list[Any]) -> Column:
        """Membership; the values of one kind make one list."""
        kinds: dict[str, list[Any]] = {}
        for v in values:
            kinds.setdefault("null" if v is None else _kind(v), []).append(v)
        found = []
        for kind, same in kinds.items():
            if kind in ("null", "array"):
                found += [self.compared(v, "eq") for v in same]
            elif (column := self.typed(same[0])) is not None:
                found.append(column.isin(same))
        return reduce(lambda a, b: a | b, found) if found else never()

    def test(self, name: str, value: Any) -> Column:
        if name == "neq":
            if value is None:
                return ~self.missing()
            column = self.typed(value)
            return always() if column is None else ~column.eqNullSafe(self.literal(value))
        if name == "in":
            return self.among(list(value))
        if name == "exists":
            return ~self.missing() if value else self.missing()
        if name in ("contains", "startsWith", "endsWith"):
            match = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[name]
            return match(self.text(), F.lit(str(value)))
        return self.compared(value, name)


def missing_test(name: str, value: Any) -> Column:
    """What an operator gives where no node of the table has the property."""
    if name == "neq":
        return never() if value is None else always()
    if name == "exists":
        return never() if value else always()
    return never()


def operators(condition: Any) -> list[tuple[str, Any]]:
    """(operator, value) pairs of one property's condition."""
    if not isinstance(condition, Mapping):
        return [("eq", condition)]
    found = []
    for key, value in condition.items():
        name = str(key).removeprefix("$")
        if name not in OPERATORS:
            raise UnknownOperator(f"unknown operator {key!r}; there are {', '.join(OPERATORS)}")
        if name == "in" and not isinstance(value, (list, tuple, set, frozenset)):
            raise ValueError("'in' takes a list")
        found.append((name, value))
    if not found:
        raise UnknownOperator("an empty condition has no meaning; leave the property out")
    return found


def compile_filter(where: Mapping[str, Any] | Column | None, fields: Mapping[str, T.DataType], prefix: str = "") -> Column:
    """The filter as one boolean column for ``where``; null counts as false.

    ``fields`` are the properties that the table has, by exact name; ``prefix`` qualifies them.
    A ready Spark column passes, for what filters can't say.
    """
    if where is None:
        return always()
    if isinstance(where, Column):
        return where
    out = None
    for name, condition in where.items():
        for op, value in operators(condition):
            if name in fields:
                found = Property(F.col(prefix + quoted(name)), fields[name]).test(op, value)
            else:
                found = missing_test(op, value)
            out = found if out is None else out & found
    return always() if out is None else out


def equalities(where: Mapping[str, Any]) -> dict[str, Any]:
    """The properties that a filter fixes to one value, as an index or an upsert would use them."""
    return {name: v for name, c in where.items() for op, v in operators(c) if op == "eq"}
