import random

import numpy as np
from helpers import DOC, EDGE, docs

from guide_engine.llm import nnpu, quality, toxicity

LABEL = "doc_id long, quality int, toxic int"


def test_prior_and_risk_recover_a_planted_class():
    rng = np.random.default_rng(2)
    p = rng.normal(2, 1, (800, 2))
    u = np.vstack([rng.normal(2, 1, (300, 2)), rng.normal(-2, 1, (700, 2))])
    prior = nnpu.class_prior(p.sum(1), u.sum(1))
    assert abs(prior - 0.3) < 0.08
    w, b = nnpu.fit_risk(p, u, prior, 60)
    assert ((p @ w + b) > 0).mean() > 0.95 and ((u[300:] @ w + b) > 0).mean() < 0.05


def held_out(spark, rows):
    return [(r["doc_id"], r["score"], r["predicted"]) for r in rows if r["held_out"]]


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    marks = {r["doc_id"]: r for r in labels.collect()}
    rows = quality.op5_query(spark, table, labels).collect()
    assert len(rows) == table.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    good = [p == marks[i]["quality"] for i, _, p in held_out(spark, rows) if i in marks]
    assert np.mean(good) > 0.9
    rows = toxicity.op9_query(spark, table, labels).collect()
    found = [(p, marks[i]["toxic"]) for i, _, p in held_out(spark, rows) if i in marks]
    assert np.mean([p == t for p, t in found]) > 0.88


def test_labels_of_held_out_rows_are_not_read(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["red", "blue", "low", "vile"] if i % 3 == 0 else ["red", "blue", "low", "high"]) for _ in range(30)) for i in range(200)]
    table = docs(spark, texts)
    marks = [(i, 1, int(i % 3 == 0)) for i in range(200)]
    from zlib import crc32

    turned = [(i, q, 1 - t if crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in marks]
    a, b = (sorted(map(tuple, toxicity.op9_query(spark, table, spark.createDataFrame(m, LABEL)).collect())) for m in (marks, turned))
    assert a == b and any(r[1] for r in a)


def test_edge_rows(spark):
    marks = spark.createDataFrame([(0, 1, 1), (4, None, 0), (None, 1, 1), (5, 1, 1), (5, 1, 1)], LABEL)
    assert quality.op5_query(spark, spark.createDataFrame([], DOC), marks).count() == 0
    table = docs(spark, EDGE)
    table = table.union(table).union(spark.createDataFrame([(None, "x y z", None, None, None, None, None)], DOC))
    for query in (quality.op5_query, toxicity.op9_query):
        for labels in (marks, spark.createDataFrame([], LABEL)):
            rows = query(spark, table, labels).collect()
            assert len(rows) == 2 * len(EDGE) + 1 and all(r["score"] is not None for r in rows)
    kept = toxicity.clean(spark, table, spark.createDataFrame([], LABEL))
    assert kept.columns == table.columns
