import zlib

import numpy as np
import public_tokenizers
from helpers import DOC, EDGE, docs
from tokenizers import Tokenizer

from guide_engine.llm import packing

ODD = ["it's 2nd-hand! naïvé ΣΑΣ  <|endoftext|> x<|startoftext|>", "a\x00b \x1c c d e", "日本語 テスト, ok?!...", "İstanbul ǅ ﬁ", "THE!! end.*** $$$ #x &&&"]


def whole(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_are_those_of_whole_texts(spark):
    texts = EDGE + ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = packing.pieces(docs(spark, texts), public_tokenizers.path("word_bpe_49k.json"), 4096, with_ids=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = got.setdefault(r["doc_id"], [])
        assert r["start"] == len(own) and 0 < r["length"] <= 4096
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        own += r["ids"]
    assert [got[i] for i in range(len(texts))] == [whole(t) for t in texts]


def covered(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(by) == list(range(len(by)))
    return len(by)


def test_sequences_are_gapless_and_full(spark):
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in np.clip(rng.lognormal(6.9, 1, 3000), 1, 4096)]
    cut = spark.createDataFrame([(i, 0, n, i, n) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(spark, cut).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    n = covered(rows, 4096)
    assert n <= 1.02 * sum(lengths) / 4096 + 1


def test_plan_places_each_rank_once():
    histogram = {4096: 3, 3000: 5, 1500: 9, 1000: 50, 7: 400, 1: 3}
    runs, n = packing.plan(histogram)
    for length, count in histogram.items():
        starts = [r[0] for r in runs[length]]
        assert starts == sorted(starts) and starts[0] == 0 and starts[-1] < count


def test_edge_tables(spark):
    assert packing.pack_documents(spark, spark.createDataFrame([], DOC)).count() == 0
    table = docs(spark, EDGE)
    table = table.union(table)
    rows = packing.pack_documents(spark, table).collect()
    covered(rows, 4096)
    want = sum(len(whole(t)) for t in EDGE)
    assert sum(r["length"] for r in rows) == 2 * want
