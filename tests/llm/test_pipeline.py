import os
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from .test_pii import brute as brute_spans
from .test_simhash import brute_components, brute_fingerprint

from encore.llm import pii, subword, toxicity

CLEAN = "alpha beta gamma delta garden river light children home along winter summer window letter".split()


def tables(spark, folder):
    """A corpus with toxic texts, exact copies, near copies and personal data."""
    r = random.Random(6)
    docs, labels = [], []
    for i in range(300):
        words = [r.choice(CLEAN) + r.choice(["", "", "s", "ly"]) for _ in range(r.randint(8, 120))]
        if i % 5 == 0:
            words.insert(r.randrange(len(words)), r.choice(["moron", "scumbag"]))
        if i % 7 == 0:
            words.insert(3, f"user{i}@mail.example.com")
        docs.append((i, " ".join(words), "en", f"s{i % 3}"))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(1000 + i, docs[i][1], "en", "s9") for i in range(1, 40)]
    long = " ".join(r.choice(CLEAN) + str(k) for k in range(400))
    docs += [(2000 + i, long + f" end{i}", "en", "s8") for i in range(10)]
    docs += [(3000, None, None, None), (3001, "", "en", "s1")]
    rows = [(*d, None if d[1] is None else len(d[1])) for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def expected(spark, folder):
    """The stages' results up to packing, in plain Python: rows ``doc_id -> text``."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    chance = toxicity.chances(model, subword.WordScores(model.projected[:, None]), [t for _, t in rows])
    rows = [x for x, c in zip(rows, chance) if c < 0.5]
    last = {}
    for d, t in rows:
        last[t or ""] = max(d, last.get(t or "", d))
    rows = [(d, t) for d, t in rows if last[t or ""] == d]
    root = brute_components([brute_fingerprint(t) for _, t in rows])
    least = {}
    for d, t in rows:
        f = root[brute_fingerprint(t)]
        least[f] = min(d, least.get(f, d))
    rows = [(d, t) for d, t in rows if least[root[brute_fingerprint(t)]] == d]
    return {d: None if t is None else pii.mask(t, brute_spans(t)) for d, t in rows}


def test_run_against_plain_python(spark, tmp_path):
    folder = str(tmp_path / "sf")
    os.makedirs(folder)
    tables(spark, folder)
    want = expected(spark, folder)
    assert 0 in {0, *want} and 2001 not in want and len(want) < 260
    got = {}
    for p in corpus_pipeline.run(spark, folder).collect():
        got.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
    assert set(got) == set(want)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    for d, text in want.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()
        assert b"".join(b for _, b in sorted(got[d])) == ids


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    folder = str(tmp_path / "sf")
    os.makedirs(folder)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == corpus_pipeline.COLUMNS and out.dtypes == docs.dtypes
        kept[name] = {r.doc_id for r in out.collect()}
    toxic = {i for i in range(300) if i % 5 == 0}
    assert len(kept["toxicity"] & toxic) <= 2  # two words in whole; a short text may go unseen
    assert len(set(range(300)) - toxic - kept["toxicity"]) <= 2
    assert kept["pii"] == {r.doc_id for r in docs.collect()}
    assert not kept["exact_dedup"] & set(range(1, 40))
    assert kept["simhash_near_dedup"] & set(range(2000, 2010)) == {2000}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "pii", "packing"]
