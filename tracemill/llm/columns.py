"""Names of columns that can't clash, and ids of any type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def own(df: DataFrame) -> list[Column]:
    """All columns of df, by their exact names."""
    return [quoted(c) for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def identified(df: DataFrame, name: str) -> tuple[Column, str]:
    """(the id column, its SQL type): whole numbers as bigint, ids of any other type as text."""
    kind = "bigint" if isinstance(df.schema[name].dataType, IntegralType) else "string"
    return quoted(name).cast(kind), kind
