"""Bring results of both engines to the same types so that values can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACES = 6
# Added before cutting digits off. Not 0.5: values with few decimals sit exactly on .5 and would fall to
# either side after a last-bit difference between two engines.
NUDGE = 0.4371


def emit(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Integers to BIGINT, dates to text, doubles cut to `places` decimals."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            scale = float(10**places)
            c = F.floor(c.cast("double") * scale + NUDGE).cast("double") / scale
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(field.name))
    return df.select(*out)


def sql(body: str, columns: str, source: str = "result", places: int = PLACES) -> str:
    """`body` is a WITH list that defines `source`; `columns` is "name:type ..." (i, d, s, b)."""
    out = []
    for item in columns.split():
        name, kind = item.split(":")
        if kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "d":
            out.append(f"floor(CAST({name} AS DOUBLE) * 1e{places} + {NUDGE}e0) / 1e{places} AS {name}")
        elif kind == "s":
            out.append(f"CAST({name} AS VARCHAR) AS {name}")
        else:
            out.append(name)
    return f"WITH {body} SELECT {', '.join(out)} FROM {source}"
