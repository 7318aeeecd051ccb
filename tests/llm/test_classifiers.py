"""Toxicity and language identification: held-out quality and defined cases."""

import random
import zlib

import numpy as np
import pytest

from encore.llm import langid, subword, toxicity

CLEAN = "the garden was full of light and the children went home along the river".split()
TOXIC = ["idiot", "moron", "scumbag", "worthless"]


def corpus(n, seed=1, bad=TOXIC):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice(CLEAN) + r.choice(["", "", "s", "ing"]) for _ in range(r.randint(5, 300))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(bad))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = corpus(600)
    return toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))


def chances(model, texts):
    return toxicity.chances(model, subword.WordScores(model.projected[:, None]), texts)


def test_few_toxic_words_in_long_texts_are_found(model):
    rows = corpus(300, seed=2)
    right = (chances(model, [t for _, t, _ in rows]) >= 0.5) == np.array([y == 1 for *_, y in rows])
    assert right.mean() > 0.97


def test_misspellings_share_ngrams(model):
    text = "the garden was full of light {} and the children went home"
    plain = chances(model, [text.format("and")])[0]
    for word in ("worthlesss", "scumbagg", "idiots"):  # none was seen in training
        assert chances(model, [text.format(word)])[0] > 100 * plain
        assert chances(model, [word])[0] > 0.5 > chances(model, ["gardening"])[0]


def test_subword_ids_do_not_depend_on_the_batch():
    words = ["a", "idiot", "é", "straße", "the" * 30]
    ids, starts = subword.subwords(words)
    for i, w in enumerate(words):
        end = starts[i + 1] if i + 1 < len(words) else len(ids)
        assert sorted(ids[starts[i] : end]) == sorted(subword.subwords([w])[0])


def tables(spark, documents, rows):
    return documents([(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_toxicity_on_tables(spark, documents, odd_rows):
    docs, labels = tables(spark, documents, corpus(400))
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (5, 1, None), (10**9, 1, 1)], labels.schema))
    m = toxicity.train(docs, labels)
    rows = odd_rows + [(50, "the garden was full of light you moron and the children went home")]
    got = toxicity.score(documents(rows, extra=True), m).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    by = {g.doc_id: g.score for g in got}
    assert by[50] >= 0.5 and by[2] == by[3] == by[7] < 0.5
    left = toxicity.clean(documents(rows, extra=True), m)
    ids = [r.doc_id for r in left.collect()]
    assert 50 not in ids and 2 in ids and ids.count(5) in (0, 2) and "score" in left.columns
    assert toxicity.score(documents([]), m).count() == 0


@pytest.mark.parametrize("rows", [[], [(i, t, 0) for i, t, _ in corpus(20)], [(i, "", i % 2) for i in range(20)]])
def test_toxicity_without_two_classes_rejects_nothing(spark, documents, rows):
    docs, labels = tables(spark, documents, rows)
    m = toxicity.train(docs, labels)
    assert all(r.score < 1e-9 for r in toxicity.score(docs, m).collect())
    assert toxicity.clean(docs, m).count() == len(rows)


def _same(a, b):
    return all(np.array_equal(getattr(a, f), getattr(b, f)) for f in a.__dataclass_fields__)


def test_models_do_not_depend_on_the_partitions(spark, documents):
    """Ids that occur several times, with unlike texts, labels and languages."""
    rows = corpus(60)
    docs, labels = tables(spark, documents, rows + [(i % 20, f"{t} more words", 1 - y) for i, t, y in rows])
    one, *others = [toxicity.train(docs.repartition(n), labels.repartition(n)) for n in (1, 3, 7)]
    assert all(_same(one, m) for m in others)
    texts = [(i % 50, ("the house and the tree " if i % 2 else "das haus und der baum ") * (1 + i % 40), "en" if i % 3 else "de", "s") for i in range(120)]
    one, *others = [langid.train(documents(texts).repartition(n)) for n in (1, 3, 7)]
    assert all(_same(one, m) for m in others)


def test_training_draws_from_whole_texts(documents):
    rows = [(i, "word " * 3000 + ("ende " if i % 2 else "finish ") * 3000, "de" if i % 2 else "en", "s") for i in range(8)]
    drawn = langid.drawn(documents(rows).selectExpr("doc_id as __id", "lang as y", "text as t")).collect()
    assert all(len(r["t"].split()) == langid.WINDOWS * langid.WINDOW for r in drawn)
    assert sum("ende" in r["t"] or "finish" in r["t"] for r in drawn) == 8


def test_training_leaves_the_held_out_fold_alone(spark, documents):
    docs, labels = tables(spark, documents, corpus(200))
    picked = toxicity.training_rows(docs, labels, "doc_id", "text", 30).collect()
    assert len(picked) <= 60
    assert all(zlib.crc32(str(r["__id"]).encode()) % 5 for r in picked)


def test_op6_held_out_quality(spark):
    rows = toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    s, y = np.array(held).T
    order = np.argsort(np.argsort(s))
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.9


def test_op7_held_out_quality(spark):
    rows = langid.op7_language_id(spark, "/root/testdata/sf0.1").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    accepted = [r for r in held if r.accepted]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in accepted]) > 0.98


def test_language_defined_cases(documents, odd_rows):
    train = [(i, " ".join(random.Random(i).choices(["der", "und", "ist", "nicht", "haus"], k=12)), "de", "s") for i in range(60)]
    train += [(100 + i, " ".join(random.Random(i).choices(["the", "and", "is", "not", "house"], k=12)), "en", "s") for i in range(60)]
    train += [(300, "und der", None, "s"), (None, "the", "en", "s"), (301, None, "de", "s")]
    m = langid.train(documents(train))
    assert m.languages == ["de", "en"]
    rows = [(2, None), (3, ""), (7, "\t 12 ! ²"), (8, "und nicht der"), (8, "und nicht der"), (9, "the house " * 20_000), (None, "the")]
    got = langid.predict(documents(rows, extra=True), m).collect()
    by = {}
    for g in got:
        by.setdefault(g.doc_id, []).append((g.lang_pred, g.score, g.accepted))
    assert by[2] == by[3] == by[7] == [("und", 0.0, False)]
    assert [x[0] for x in by[8]] == ["de", "de"] and by[9][0][0] == "en" and by[None][0][0] == "en"
    assert all(0 <= g.score <= 1 for g in got)
    assert langid.predict(documents([]), m).count() == 0
    nothing = langid.train(documents([]))
    assert [tuple(r)[1:] for r in langid.predict(documents(rows[-2:]), nothing).collect()] == [("und", 0.0, False)] * 2


def test_every_language_is_learned_from(documents, monkeypatch):
    monkeypatch.setattr(langid, "fit", lambda texts, languages: languages)
    rows = [(i, f"text {i}", f"l{i % 450:03d}", "s0") for i in range(4500)]
    assert len(set(langid.train(documents(rows)))) == 450
    monkeypatch.setattr(langid, "TOTAL_ROWS", 450, raising=False)
    monkeypatch.setattr(langid, "LEAST_ROWS", 4, raising=False)
    assert 1000 < len(langid.train(documents(rows))) < 2500  # about 4 of 7.5 rows a language


def test_training_reads_whole_texts(spark, documents):
    rows = [(i, f"{'garden ' * 4000}{'moron' if i % 2 else 'river'}", i % 2) for i in range(20)]
    docs, labels = tables(spark, documents, rows)
    got = toxicity.training_rows(docs, labels, "doc_id", "text", 100).collect()
    assert got and all(r["t"] == rows[r["__id"]][1] for r in got)
    model = toxicity.train(docs, labels)
    assert chances(model, ["garden moron garden garden"])[0] > chances(model, ["garden river garden garden"])[0]


def test_training_texts_are_bounded_together(spark, documents):
    rows = corpus(200) + [(900, "moron " * 4000, 1), (901, None, 0)]
    docs, labels = tables(spark, documents, rows)
    whole = {r["__id"]: r for r in toxicity.training_rows(docs, labels, "doc_id", "text", 2000).collect()}
    got = toxicity.training_rows(docs, labels, "doc_id", "text", 2000, max_chars=20_000).collect()
    assert 0 < len(got) < len(whole) and 900 in whole and all(whole[r["__id"]]["t"] == r["t"] for r in got)
    for y in (0, 1):
        assert 10_000 < sum(len(r["t"] or "") for r in got if r["y"] == y) <= 20_000
    assert toxicity.train(docs, labels, max_chars=1).slope == 0
