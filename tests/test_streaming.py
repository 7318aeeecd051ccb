"""Incremental ingest: files arriving in two rounds are ingested exactly once."""

import os

from encore.streaming.ingest import refresh_curated, start_ingest


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_incremental_ingest(spark, tmp_path):
    src, raw, ck, cur = (str(tmp_path / x) for x in ("exports", "raw", "ckpt", "curated"))
    _write(f"{src}/a.json", '[{"ts":"2024-01-01T00:00:00Z","ms_played":60000},{"ts":"2024-01-01T00:10:00Z"}]')
    q = start_ingest(spark, src, raw, ck)
    q.awaitTermination(120)
    assert spark.read.parquet(raw).count() == 2
    _write(f"{src}/sub/b.json", '{"ts":"2024-01-02T00:00:00Z","ms_played":1}\nbad line\n')
    q = start_ingest(spark, src, raw, ck)
    q.awaitTermination(120)
    r = spark.read.parquet(raw)
    assert r.count() == 3
    assert sorted(x["source_file"] for x in r.collect()) == ["a.json", "a.json", "b.json"]
    refresh_curated(spark, raw, cur)
    c = spark.read.parquet(cur)
    assert c.count() == 3
    assert sorted(x["session_id"] for x in c.collect()) == [1, 1, 2]
