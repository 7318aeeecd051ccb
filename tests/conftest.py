import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from encore.session import local_session

    s = local_session("*", shuffle_partitions=8, app="encore-tests")
    yield s


def raw_rows(spark, rows):
    """Raw plays from dicts (missing keys -> NULL), completed to the raw schema."""
    from encore.operators.prepare import complete_raw
    from encore.schema import RAW_SCHEMA

    cols = [f.name for f in RAW_SCHEMA.fields]
    data = [tuple(r.get(c) for c in cols) for r in rows]
    return complete_raw(spark.createDataFrame(data, RAW_SCHEMA))


def ts(s):
    return dt.datetime.fromisoformat(s)


@pytest.fixture
def make_plays(spark):
    from encore.operators.prepare import prepare_plays

    def _make(rows, sessions=True):
        return prepare_plays(raw_rows(spark, rows), with_sessions=sessions)

    return _make
