"""SQL templates: text with named parameters. Values are bound by Spark, names of tables and columns are checked identifiers."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..errors import QueryError, TemplateError
from ..functions.predicates import column_names, parsed

SYMBOLS = {"eq": "=", "not_eq": "!=", "in": "in", "not_in": "not in", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


@dataclass(frozen=True)
class Rendered:
    text: str
    args: dict[str, Any]

    def run(self, spark: SparkSession) -> DataFrame:
        return spark.sql(self.text, args=self.args)


def render(template: str, *, select: list[str] | None = None, filters: dict[str, Any] | None = None, **names: str) -> Rendered:
    """{select} and {where} of a template become a list of columns and a WHERE clause, other fields checked identifiers."""
    for k, v in names.items():
        if not re.fullmatch(r"\w+(\.\w+){0,2}", v or ""):
            raise TemplateError(f"{k} is no identifier")
    args: dict[str, Any] = {}
    terms = []
    for i, ((column, _, value), key) in enumerate(zip(parsed(filters or {}), filters or {}, strict=True)):
        symbol = SYMBOLS[key.split("__")[1]]
        if isinstance(value, list):
            marks = []
            for j, v in enumerate(value):
                args[f"p{i}_{j}"] = v
                marks.append(f":p{i}_{j}")
            terms.append(f"{column} {symbol} ({', '.join(marks)})")
        else:
            args[f"p{i}"] = value
            terms.append(f"{column} {symbol} :p{i}")
    columns = ", ".join(column_names(select or [])) or "*"
    text = template.format(select=f"select {columns}", where="where " + "\n    and ".join(terms) if terms else "", **names)
    return Rendered("\n".join(x for x in text.strip().splitlines() if x.strip()), args)


def validate(spark: SparkSession, query: Rendered) -> None:
    """An error if the query does not parse or resolve; nothing runs."""
    try:
        query.run(spark)
    except (ParseException, AnalysisException) as e:
        raise QueryError(str(e).splitlines()[0]) from e
