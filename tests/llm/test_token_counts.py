from collections import Counter

import pytest
from pyspark.sql import functions as F

from encore.llm import token_counts as tc


def n(name, text):
    return len(tc.tokenizer(name).encode_ordinary(text or ""))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    docs_n, tokens = Counter(), Counter()
    for d in docs:
        if len(d.text) < tc.SHORT:
            continue
        version = tc.FIRST if d.lang == "en" else tc.SECOND
        docs_n[d.source, d.lang, version] += 1
        tokens[d.source, d.lang, version] += n(version, d.text)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in tc.op10_token_counts(spark, "/root/testdata/sf0.01").collect()}
    assert got == {k: (docs_n[k], tokens[k]) for k in docs_n}


def test_odd_rows(documents, odd_rows):
    rows = tc.counted(documents(odd_rows, extra=True), {tc.FIRST: F.lit(True), tc.SECOND: F.col("doc_id") > 5})
    assert "text" not in rows.columns and "rid" in rows.columns
    got = sorted([(r.doc_id, r[tc.FIRST], r[tc.SECOND]) for r in rows.collect()], key=repr)
    assert got == sorted([(d, n(tc.FIRST, t), n(tc.SECOND, t) if d is not None and d > 5 else None) for d, t in odd_rows], key=repr)


def test_batches_are_additive_and_idempotent(spark, documents, tmp_path):
    rows = [(1, "one two three", "en", "a"), (2, "vier fünf", "de", "a"), (3, None, None, None), (4, "", "en", "b"), (2, "vier fünf", "de", "a")]
    docs = tc.counted(documents(rows), {tc.FIRST: F.lit(True), tc.SECOND: F.lit(True)}).cache()
    rollup = tc.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().collect() == [] and rollup.batches() == []

    def totals():
        return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}

    rollup.commit("first", tc.inserts(docs, "v1", tc.FIRST))
    a = {("a", "en", "v1"): (1, n(tc.FIRST, rows[0][1])), ("a", "de", "v1"): (2, 2 * n(tc.FIRST, rows[1][1])), (None, None, "v1"): (1, 0), ("b", "en", "v1"): (1, 0)}
    assert totals() == a
    rollup.commit("first", tc.inserts(docs, "v1", tc.FIRST))  # a retry changes nothing
    assert totals() == a
    german = docs.where("lang = 'de'")
    for _ in range(2):
        rollup.commit("second", tc.revisions(german, ("v1", tc.FIRST), ("v2", tc.SECOND)))
    a[("a", "de", "v2")] = (2, 2 * n(tc.SECOND, rows[1][1]))
    del a[("a", "de", "v1")]
    assert totals() == a
    rollup.commit("third", tc.deletes(docs.where("doc_id = 4"), "v1", tc.FIRST))
    del a[("b", "en", "v1")]
    assert totals() == a
    rollup.commit("nothing", tc.deletes(docs.where("doc_id = 99"), "v1", tc.FIRST))
    assert totals() == a and rollup.batches() == ["first", "nothing", "second", "third"]
    with pytest.raises(ValueError):
        rollup.commit("a/b", tc.inserts(docs, "v1", tc.FIRST))


def test_a_broken_off_commit_is_not_counted(spark, documents, tmp_path, monkeypatch):
    docs = tc.counted(documents([(1, "one two")]), {tc.FIRST: F.lit(True)})
    rollup = tc.Rollup(spark, str(tmp_path / "rollup"))
    rollup.commit("done", tc.inserts(docs, "v1", tc.FIRST))
    with monkeypatch.context() as m:  # the driver is lost after the write, before the rename
        m.setattr(tc.fs, "publish_version", lambda *a, **k: None)
        rollup.commit("broken", tc.inserts(docs, "v1", tc.FIRST))
        rollup.commit("done", tc.deletes(docs, "v1", tc.FIRST))
    assert rollup.batches() == ["done"] and [r.n_docs for r in rollup.totals().collect()] == [1]


def test_a_commit_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    from encore.sources import fs

    def delta(n):
        return spark.createDataFrame([("s", "en", "t", 1, n)], tc.ROLLUP)

    rollup = tc.Rollup(spark, str(tmp_path / "r"))
    rollup.commit("a", delta(5))
    real = fs._path

    def crash(s, p):
        if p.endswith(".done"):
            raise RuntimeError("lost")
        return real(s, p)

    monkeypatch.setattr(fs, "_path", crash)
    with pytest.raises(RuntimeError):
        rollup.commit("a", delta(7))
    monkeypatch.setattr(fs, "_path", real)
    assert [r["n_tokens"] for r in rollup.totals().collect()] == [5]
    rollup.commit("a", delta(7))
    assert [r["n_tokens"] for r in rollup.totals().collect()] == [7] and rollup.batches() == ["a"]
