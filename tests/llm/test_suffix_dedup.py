import hashlib
import random
from collections import Counter

from helpers import DOC, EDGE, docs

from guide_engine.llm import suffix_dedup


def brute(texts, size=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + size] for r in raws for p in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for p in range(len(r) - size + 1):
            if seen[r[p : p + size]] > 1:
                gone[p : p + size] = [True] * size
        runs = sum(g and (q == 0 or not gone[q - 1]) for q, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def got(spark, table):
    return {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.op3_query(spark, table).collect()}


def hard_texts(seed=4):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, short = noise(420), noise(199)
    out = ["ab" * 700, "abc" * 300, "x" * 900, noise(150), short, short + "q", short + "r"]
    for k in range(12):
        a = rng.randrange(0, 200)
        out.append(noise(rng.randrange(0, 300)) + passage[a : a + rng.randrange(150, 400)] + noise(rng.randrange(0, 300)))
    base = noise(1500)
    for k in range(8):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(1500)] = "#"
        out.append("".join(t))
    out += [base, base, base[: len(base) - 1], "z" + base, noise(400) + "-" * 250 + noise(100)]
    return out


def test_equals_brute_force(spark, monkeypatch):
    texts = EDGE + hard_texts()
    want = brute(texts)
    assert got(spark, docs(spark, texts)) == dict(enumerate(want))
    assert sum(w[1] for w in want) > 5000


def test_long_texts_are_read_in_stretches():
    import numpy as np

    text = "".join(random.Random(9).choice("abcd ") for _ in range(4000))
    raw = np.frombuffer((text + text[:900]).encode(), np.uint8)
    whole = suffix_dedup.runs_of(raw, np.array([0, len(raw)]))
    old = suffix_dedup.SEGMENT
    suffix_dedup.SEGMENT = 700
    try:
        cut = suffix_dedup.runs_of(raw, np.array([0, len(raw)]))
    finally:
        suffix_dedup.SEGMENT = old
    spread = lambda r: sorted((int(a) + k, int(key)) for a, n, key in zip(r[1], r[2], r[3]) for k in range(int(n)))
    assert spread(whole) == spread(cut)


def test_edge_tables(spark):
    assert suffix_dedup.op3_query(spark, spark.createDataFrame([], DOC)).count() == 0
    one = docs(spark, ["q" * 100 + "w" * 150, None, "short"])
    unknown = spark.createDataFrame([(None, "y" * 10 + "".join(map(str, range(300))), None, None, None, None, None)], DOC)
    rows = suffix_dedup.op3_query(spark, one.union(one).union(unknown)).collect()
    assert sorted((r["doc_id"] is None, r["n_bytes"], r["n_removed"]) for r in rows) == [(False, 0, 0), (False, 0, 0), (False, 5, 0), (False, 5, 0), (False, 250, 250), (False, 250, 250), (True, 800, 0)]
