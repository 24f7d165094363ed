import random
from collections import defaultdict

import numpy as np
from helpers import DOC, EDGE, docs

from guide_engine.llm import minhash
from guide_engine.llm.common import Tables, word_hashes
from guide_engine.llm.graph import components


def shingles(text, size=3):
    w = (text or "").encode().lower().split()
    size = min(size, len(w))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w else frozenset()


def brute(texts, size, threshold):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def families(seed, n=160):
    """Edited copies of a base whose similarities straddle the threshold, and chains of edits."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = []
    for base in range(3):
        text = [word() for _ in range(150)]
        now = list(text)
        for k in range(n // 4):
            copy = list(text)
            for _ in range(rng.randint(0, 7)):
                copy[rng.randrange(150)] = word()
            now[(k * 13) % 150] = word()
            out += [" ".join(copy), " ".join(now)]
    rng.shuffle(out)
    return out


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    texts = EDGE + families(5) + ["A b C", "a B c", "a b", "b a"]
    table = docs(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.op4_query(spark, table).collect()}
    assert got == brute(dict(enumerate(texts)), 3, 85)


def test_components_equal_brute_force_on_data(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    rows = minhash.op4_query(spark, table).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(texts, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_edge_tables(spark):
    assert minhash.op4_query(spark, spark.createDataFrame([], DOC)).count() == 0
    table = docs(spark, ["a b c d", "a b c d", None])
    table = table.union(table).union(spark.createDataFrame([(None, "a b c d", None, None, None, None, None)], DOC))
    rows = minhash.near_duplicates(spark, table).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None) == [
        (False, 0, 0, True), (False, 0, 0, True), (False, 1, 0, False), (False, 1, 0, False), (False, 2, 2, True), (False, 2, 2, True)]
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]


def test_words_and_estimate():
    text = "  Ab\tcd\x0bÉ\x1fx \n"
    words, first, end = word_hashes(np.frombuffer(text.encode(), np.uint8))
    assert [text.encode()[a:b] for a, b in zip(first, end)] == [b"Ab", b"cd", "É\x1fx".encode()]
    assert words[0] == word_hashes(np.frombuffer(b"aB", np.uint8))[0][0]
    assert abs(minhash.estimate(0) - 1) < 1e-9 and abs(minhash.estimate(180)) < 1e-9
    assert minhash.margin(0.85) > 192 * 0.14


def test_graph_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for x in sorted(near):
        stack = [x] if x not in want else []
        while stack:
            y = stack.pop()
            if y not in want:
                want[y] = x
                stack += near[y]
    got = components(Tables(spark), spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_intersections_both_ways():
    rng = np.random.default_rng(1)
    items = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(9)]
    left, right = np.array([(i, j) for i in range(9) for j in range(9) if i != j]).T
    want = [len(np.intersect1d(items[i], items[j])) for i, j in zip(left, right)]
    assert minhash.intersections(items, left, right, 7).tolist() == want
    assert minhash.intersections(items, left[:9], right[:9]).tolist() == want[:9]


def test_bands_follow_the_threshold(spark):
    for threshold in (80, 85):
        put, seen = Tables.put, {}
        try:
            Tables.put = lambda self, name, df: seen.setdefault(name, put(self, name, df))
            minhash.near_duplicates(spark, docs(spark, ["a b c d e f g"]), threshold=threshold)
        finally:
            Tables.put = put
        n = len(seen["sketches"].first()["bands"])
        assert n * minhash.ROWS <= minhash.HASHES and (1 - (threshold / 100) ** minhash.ROWS) ** n <= 1e-6
