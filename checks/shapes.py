"""One column list per query, applied to the Spark result and to the DuckDB statement.

Kinds: ``int`` (64 bit), ``num`` (double, rounded to 6 places), ``str``, ``bool``,
``day`` (ISO text) and ``list`` (sorted, comma separated text).

Sums of doubles differ in the last bits with the order of summation.  Shares of whole
seconds often lie exactly half-way between two rounded values, so ``num`` moves every
value by ``NUDGE`` first; both engines then round the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Shape = dict[str, str]
NUDGE = 1e-8


def shape(**kinds: str) -> Shape:
    """``shape(int="a b", num="c")`` -> ``{"a": "int", "b": "int", "c": "num"}``."""
    return {name: kind for kind, names in kinds.items() for name in names.split()}


def _spark_column(name: str, kind: str) -> Column:
    column = F.col(name)
    if kind == "int":
        column = column.cast("long")
    elif kind == "num":
        column = F.round(column.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)
    elif kind == "day":
        column = column.cast("date").cast("string")
    elif kind == "list":
        column = F.array_join(F.array_sort(column), ",")
    return column.alias(name)


def shaped(df: DataFrame, columns: Shape) -> DataFrame:
    return df.select(*(_spark_column(name, kind) for name, kind in columns.items()))


def shaped_sql(body: str, columns: Shape, with_clause: str = "") -> str:
    forms = {
        "int": "CAST({0} AS BIGINT)",
        "num": f"round(CAST({{0}} AS DOUBLE) + {NUDGE}::DOUBLE, 6) + 0.0",
        "day": "CAST(CAST({0} AS DATE) AS VARCHAR)",
        "list": "array_to_string(list_sort({0}), ',')",
    }
    select = ", ".join(f"{forms.get(kind, '{0}').format(name)} AS {name}" for name, kind in columns.items())
    return f"{with_clause}SELECT {select} FROM ({body}) AS result"
