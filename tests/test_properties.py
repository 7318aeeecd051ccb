"""Random logs: Spark operators equal a direct pandas computation of the same definitions."""

import datetime as dt

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from encore.operators import aggregates as A
from encore.operators import trends as TR

from conftest import raw_rows

BASE = dt.datetime(2024, 1, 1)

play = st.tuples(
    st.integers(min_value=0, max_value=60 * 24 * 40),   # minute offset within ~40 days
    st.integers(min_value=-5, max_value=400) .map(lambda s: float(s * 1000)),
    st.sampled_from(["A", "B", "C", None]),
    st.booleans(),
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(play, min_size=1, max_size=40))
def test_trend_weekly_kpis_sessions_match_pandas(spark, rows):
    from encore.operators.prepare import prepare_plays

    recs = [{"ts": BASE + dt.timedelta(minutes=m), "ms_played": ms, "master_metadata_album_artist_name": a,
             "skipped": sk, "source_file": f"f{i}"} for i, (m, ms, a, sk) in enumerate(rows)]
    p = prepare_plays(raw_rows(spark, recs).repartition(3))

    df = pd.DataFrame(recs)
    df["ms"] = df["ms_played"].clip(lower=0)
    df["date"] = df["ts"].dt.date
    daily = df.groupby("date")["ms"].sum().sort_index()
    hours = daily / 3.6e6
    roll = hours.rolling(7, min_periods=1).mean()
    cum = hours.cumsum()

    got = TR.daily_trend(p).orderBy("date").collect()
    assert [r["date"] for r in got] == list(daily.index)
    for r, h, ro, c in zip(got, hours, roll, cum):
        assert abs(r["play_hours"] - h) < 1e-9 and abs(r["rolling_7d"] - ro) < 1e-9 and abs(r["cumulative_hours"] - c) < 1e-9

    weekly = hours.copy()
    weekly.index = pd.to_datetime(weekly.index)
    ref_w = weekly.resample("W").sum()
    got_w = {r["date"]: r["play_hours"] for r in TR.weekly_hours(p).collect()}
    assert {k.date(): round(v, 9) for k, v in ref_w.items()} == {k: round(v, 9) for k, v in got_w.items()}

    k = A.kpis(p).first()
    assert k["rows"] == len(df)
    assert abs(k["skip_rate"] - 100 * df["skipped"].mean()) < 1e-9
    assert k["unique_artists"] == df["master_metadata_album_artist_name"].fillna("Unknown Artist").nunique()

    s = df.sort_values("ts")
    brk = (s["ts"].diff().dt.total_seconds().fillna(0) > 1800).cumsum() + 1
    ref_s = dict(zip(s["source_file"], brk))
    got_s = {r["source_file"]: r["session_id"] for r in p.select("source_file", "session_id").collect()}
    assert got_s == ref_s
