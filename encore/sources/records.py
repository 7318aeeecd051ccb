"""Record sink (S5): select columns, fill NULLs (numbers -> 0, everything else -> ""), and
emit rows or JSON lines. Written by the executors; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_records(df: DataFrame, columns: list[str]) -> DataFrame:
    out = []
    for f in df.select(*columns).schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.NumericType):
            out.append(F.coalesce(c, F.lit(0).cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            fmt = "yyyy-MM-dd" if isinstance(f.dataType, T.DateType) else "yyyy-MM-dd HH:mm:ss"
            out.append(F.coalesce(F.date_format(c, fmt), F.lit("")).alias(f.name))
        else:
            out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def to_json_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object per row (``value`` column), ready for ``write.text``."""
    return to_records(df, columns).select(F.to_json(F.struct(*columns)).alias("value"))
