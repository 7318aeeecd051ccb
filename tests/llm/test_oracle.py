"""Registered corpus queries: their SQL, their names, and inputs they must read whole."""

import __spark_entry__ as E
import corpus_pipeline
import pytest

from encore.llm import queries
from encore.plans.checker import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_matches(spark, name):
    assert compare(spark, SF, names=[name], verbose=False)[name]["ok"] is True


def test_one_query_per_operator_and_the_pipeline():
    names = [q for q in E.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert E.queries()["pipeline"] is corpus_pipeline.run
    assert set(queries.SQL) <= set(E.oracle_sql())


def test_rest_does_not_need_the_subpackage():
    """Nothing outside the subpackage, its tests and the pipeline imports it, but the guarded entry."""
    import pathlib
    import re

    root = pathlib.Path(E.__file__).parent
    uses = [
        p.relative_to(root).as_posix()
        for p in root.rglob("*.py")
        if re.search(r"encore\.llm|corpus_pipeline", p.read_text())
        and not p.relative_to(root).as_posix().startswith(("encore/llm/", "tests/llm/", "corpus_pipeline"))
    ]
    assert uses == ["__spark_entry__.py"]
