import random

import corpus_pipeline
from helpers import DOC, docs
from test_decontaminate import distance
from test_minhash import brute

from guide_engine.llm import decontaminate, packing, pii, toxicity


def test_stages_decide_as_brute_force(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    item = " ".join(word() for _ in range(12))
    base = [word() for _ in range(80)]
    texts = [" ".join(word() for _ in range(60)) for _ in range(30)] + [" ".join(base), " ".join(base), " ".join([*base[:-1], "x"]), None, "", None]
    texts += [f"{word()} {item} {word()}", f"{word()} me@mail.example.com and {word()} +1 (555) 123-4567"]
    texts += [" ".join(["vile", *(word() for _ in range(20)), "scum"]) for _ in range(40)]
    path = str(tmp_path)
    table = docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 38)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    now = table
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, path)
        if name != "packing":
            assert after.columns == table.columns
            after.write.parquet(f"{path}/{name}")
            after = spark.read.parquet(f"{path}/{name}")
            kept.append({r["doc_id"]: r["text"] for r in after.collect()})
        now = after
    assert set(kept[0]) == set(range(38))
    want = brute({i: texts[i] for i in kept[0]}, 5, 80)
    assert set(kept[1]) == {i for i, (_, c) in want.items() if c == i}
    assert set(kept[2]) == {i for i, t in kept[1].items() if distance(item, decontaminate.normal(t)) > decontaminate.budget(len(item))}
    assert 36 not in kept[2] and "<EMAIL>" in kept[3][37] and "<PHONE>" in kept[3][37]
    assert all(not pii.base_spans(t or "") for t in kept[3].values())
    assert {r["doc_id"] for r in now.collect()} == set(kept[3])
    ran = corpus_pipeline.run(spark, path)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, now.collect()))


def test_empty_documents(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], DOC).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
