"""Dashboard filters (F3-F6): inclusive date range, artist list, content types.

Predicates are plain column expressions so Catalyst pushes them into the Parquet scan; the
date range also emits a ``year`` predicate, which prunes whole ``year=`` partitions of the
curated table (Spark does not derive it from a ``date`` predicate by itself).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.schema import ARTIST

_TYPE_FLAG = {"Songs": "is_song", "Podcasts": "is_podcast", "Audiobooks": "is_audiobook"}


def _as_date(v) -> dt.date | None:
    if v is None or v == "":
        return None
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    return dt.date.fromisoformat(str(v)[:10])


def date_range(plays: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive at both ends on the UTC date; an absent bound adds no predicate."""
    s, e = _as_date(start), _as_date(end)
    if s is not None:
        plays = plays.where((F.col("year") >= s.year) & (F.col("date") >= F.lit(s)))
    if e is not None:
        plays = plays.where((F.col("year") <= e.year) & (F.col("date") <= F.lit(e)))
    return plays


def artists(plays: DataFrame, names: list[str] | None) -> DataFrame:
    """Empty or missing list = no filter."""
    if not names:
        return plays
    return plays.where(F.col(ARTIST).isin(list(dict.fromkeys(names))))


def content_types(plays: DataFrame, types: list[str] | None) -> DataFrame:
    """OR of the named flags; unknown names match nothing; empty list or all three = no filter."""
    if not types:
        return plays
    flags = {_TYPE_FLAG[t] for t in types if t in _TYPE_FLAG}
    if set(_TYPE_FLAG.values()) <= flags:
        return plays  # song is the residual of the other two: the disjunction is always true
    if not flags:
        return plays.where(F.lit(False))
    cond: Column | None = None
    for f in sorted(flags):
        cond = F.col(f) if cond is None else (cond | F.col(f))
    return plays.where(cond)


def subset(plays: DataFrame, kind: str) -> DataFrame:
    """``songs`` / ``podcasts`` / ``audiobooks`` as filters, never copies."""
    flag = {"songs": "is_song", "podcasts": "is_podcast", "audiobooks": "is_audiobook"}[kind]
    return plays.where(F.col(flag))


def apply_filters(plays: DataFrame, start=None, end=None, artist_list=None, types=None) -> DataFrame:
    """The dashboard's filter chain. ``types=None`` means all three content types."""
    out = date_range(plays, start, end)
    out = artists(out, artist_list)
    return content_types(out, types)
