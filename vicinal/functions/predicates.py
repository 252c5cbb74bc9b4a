"""Filters and projections from plain data: {column__operator: value} and lists of names.

Values become literals of the plan, never text of a query, so quoting cannot go wrong and filters are pushed to the scan.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FilterSyntaxError, TemplateError, UnsupportedTypeError

REQUIRED_COLUMNS = ("c.cas_cell_index", "c.cas_ingest_id")


def _scalar(value: Any) -> Any:
    if not isinstance(value, (str, bool, int, float)):
        raise UnsupportedTypeError(f"{type(value).__name__} is no filter value")
    return value


def _number(value: Any) -> Any:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise UnsupportedTypeError(f"{type(value).__name__} cannot be compared by order")
    return value


def _members(value: Any) -> list:
    if not isinstance(value, (list, tuple)):
        raise UnsupportedTypeError("a list is asked for")
    if not value:
        raise FilterSyntaxError("an empty list matches nothing")
    if isinstance(value[0], bool) or not isinstance(value[0], (str, int, float)) or any(type(v) is not type(value[0]) for v in value):
        raise UnsupportedTypeError("a list holds strings, integers or floats, all of one type")
    return [*value]


@dataclass(frozen=True)
class Operator:
    check: Callable[[Any], Any]
    build: Callable[[Column, Any], Column]


OPERATORS = {
    "eq": Operator(_scalar, operator.eq),
    "not_eq": Operator(_scalar, operator.ne),
    "in": Operator(_members, lambda c, v: c.isin(v)),
    "not_in": Operator(_members, lambda c, v: ~c.isin(v)),
    "gt": Operator(_number, operator.gt),
    "gte": Operator(_number, operator.ge),
    "lt": Operator(_number, operator.lt),
    "lte": Operator(_number, operator.le),
}


def checked_name(name: str) -> str:
    """A column name with at most one alias."""
    if not name or name.count(".") > 1:
        raise ValueError(f"{name!r} is no column name")
    return name


def parsed(filters: dict[str, Any]) -> list[tuple[str, Operator, Any]]:
    """Column, operator and checked value of each entry, in order."""
    out = []
    for key, value in filters.items():
        parts = key.split("__")
        if len(parts) != 2:
            raise FilterSyntaxError(f"{key!r} is not column__operator")
        if parts[1] not in OPERATORS:
            raise FilterSyntaxError(f"{parts[1]!r} is not one of {', '.join(OPERATORS)}")
        out.append((checked_name(parts[0]), OPERATORS[parts[1]], OPERATORS[parts[1]].check(value)))
    return out


def where(filters: dict[str, Any] | None) -> Column:
    """The conjunction of all filters; true when there are none."""
    return reduce(operator.and_, (op.build(F.col(c), v) for c, op, v in parsed(filters or {})), F.lit(True))


def column_names(names: Iterable[str]) -> list[str]:
    """Lower-cased, each once, in order of first appearance."""
    return [checked_name(n) for n in dict.fromkeys(n.lower() for n in names)]


def select(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The named columns; all of them when none is named."""
    found = column_names(names)
    return df.select(*found) if found else df.select("*")


def with_required(names: Iterable[str]) -> list[str]:
    return column_names([*REQUIRED_COLUMNS, *names])


def without_alias(names: Iterable[str]) -> list[str]:
    """What follows the last period."""
    return [n.rpartition(".")[2] for n in names]


def select_bare(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Columns by aliased names, under their bare names."""
    found = column_names(names)
    return df.select(*(F.col(n).alias(b) for n, b in zip(found, without_alias(found), strict=True)))


@dataclass(frozen=True)
class TemplateData:
    """What a template is filled with, checked when it is made."""

    project: str
    dataset: str | None = None
    select: list[str] | None = None
    filters: dict[str, Any] | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if not self.project:
            raise TemplateError("a project is asked for")
        if self.dataset is not None and not self.dataset:
            raise TemplateError("the dataset is empty")
        if self.select is not None and not self.select:
            raise TemplateError("the list of columns is empty")
        parsed(self.filters or {})

    def apply(self, df: DataFrame) -> DataFrame:
        return select(df.filter(where(self.filters)), self.select or [])
