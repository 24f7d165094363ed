"""Repeated ids with different texts, conflicting labels, very long texts, clashing columns: rows are told apart and none is lost."""

import random

import numpy as np
from helpers import DOC, docs
from pyspark.sql import functions as F

from guide_engine.llm import common, decontaminate, minhash, nnpu, pii, suffix_dedup

A, B = "one two three four five six seven eight nine ten", "red green blue cyan black white grey pink brown lime"


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", None, k, -1) for k, (i, t) in enumerate(pairs)], DOC)


def test_near_copies_under_one_id(spark):
    table = rows(spark, [(3, A), (5, A), (5, B), (5, B), (None, A), (7, None), (7, None), (9, B + " more")])
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark, table, 3, 85).collect()]
    assert sorted(got, key=repr) == sorted([(3, 8, 3, True), (5, 8, 3, False), (5, 8, 5, True), (5, 8, 5, True), (None, 8, None, True), (7, 0, 7, True), (7, 0, 7, True), (9, 9, 5, False)], key=repr)
    kept = minhash.keep_one(spark, table, 3, 85)
    assert kept.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(3, A), (5, B), (None, A), (7, None), (7, None)], key=repr)


def test_samples_draw_ids_before_texts(spark, monkeypatch):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["vile", "scum", "sun", "sea"] if i % 2 else ["sun", "sea", "sky"]) for _ in range(12))) for i in range(60)]
    table = rows(spark, texts + [texts[1]] * 50 + [(1, "another text")])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(2, 1, 1), (999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    positive, others = nnpu.samples(table, labels, "toxic", F.lit(True))
    assert len(positive) == 31 and len(others) == 60  # an id with both labels is positive; one without a document gives nothing
    monkeypatch.setattr(nnpu, "MAX_POSITIVE", 10)
    monkeypatch.setattr(nnpu, "MAX_UNLABELLED", 7)
    positive, others = nnpu.samples(table, labels, "toxic", F.lit(True))
    assert len(others) == 7 and 9 <= len(positive) <= 10
    long = rows(spark, [(0, "sun " * 200_000), (1, "vile scum"), (2, None)])
    positive, others = nnpu.samples(long, labels, "toxic", F.lit(True))
    assert len(others) == 3 and max(len(w) for _, w in others) > 0


def test_repeated_and_unnamed_rows_of_exact_removal(spark):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    x, y = noise(700), noise(500)
    table = rows(spark, [(None, x), (None, y), (None, noise(300) + x[100:400]), (4, y), (4, noise(250)), (4, y), (6, "é" * 150), (8, noise(199))])
    from test_suffix_dedup import brute

    texts = [r["text"] for r in table.collect()]
    want = [(r["doc_id"], *w) for r, w in zip(table.collect(), brute(texts))]
    got = [tuple(r) for r in suffix_dedup.op3_query(spark, table).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[2] for w in want) > 1500


def test_stages_take_long_texts_in_slices(spark):
    item = " ".join(f"item{k}" for k in range(20))
    long = "filler words and more " * 120_000  # 2.6 MB
    table = rows(spark, [(1, long + item), (2, long + " me@mail.org " + "x" * 50), (3, "short " + item), (4, None), (5, "")])
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, " ")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.clean(spark, table, benchmark).collect()) == [2, 4, 5]
    quiet = pii.Tagger()
    quiet.p["ob"][0] = 50  # finds nothing: the patterns alone
    out = {r["doc_id"]: r["text"] for r in pii.redact(spark, table, quiet).collect()}
    assert out[4] is None and out[2].endswith(" <EMAIL> " + "x" * 50) and len(out[1]) == len(long + item)


def test_shared_folder_and_passing_tables(spark):
    tables = common.Tables(spark)
    frame = tables.put("kept", spark.range(3))
    with common.passing():
        inner = common.Tables(spark)
        inner.put("gone", spark.range(2))
        assert inner.paths
    assert not inner.paths and frame.count() == 3
    assert np.array_equal(common.splitmix(1, 3), common.splitmix(1, 3))
