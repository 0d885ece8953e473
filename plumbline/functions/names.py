"""Columns by name, whatever the name holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """name as SQL and column functions read it."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


# Characters of Unicode's private use that stand for those that column functions read as syntax.
_MARKS = {".": "\ue000", "`": "\ue001"}
_PLAIN, _SHOWN = str.maketrans(_MARKS), str.maketrans({v: k for k, v in _MARKS.items()})


def plain(name: str) -> str:
    """name without characters that column functions read as syntax."""
    return name.translate(_PLAIN)


def missing_nan(df: DataFrame) -> DataFrame:
    """df with null for NaN; a table without floating numbers is returned as it is."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")]
    return df.select(*(F.nanvl(col(c), F.lit(None).cast(df.schema[c].dataType)).alias(c) if c in floats else col(c) for c in df.columns)) if floats else df


def entered(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df as analyses read it, and how to show their results: NaN is missing, that is null, and column names are plain(); in
    results, names and texts have the original characters again."""
    odd = any(plain(c) != c for c in df.columns)
    rows = missing_nan(df)

    def shown(out: DataFrame) -> DataFrame:
        if not odd:
            return out
        back = lambda c: F.translate(F.col(c), "".join(_MARKS.values()), "".join(_MARKS))
        return out.select(*((back(c) if t == "string" else F.col(c)).alias(c.translate(_SHOWN)) for c, t in out.dtypes))

    return rows.toDF(*map(plain, df.columns)) if odd else rows, shown
