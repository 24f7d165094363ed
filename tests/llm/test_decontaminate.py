import random

from helpers import DOC, EDGE, docs

from guide_engine.llm import decontaminate as d

ITEM = "item_id long, text string, doc_id long"


def distance(a, b):
    """Least edits of a to any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return min(row)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t))
        rng.choice([lambda: t.__setitem__(k, "#"), lambda: t.insert(k, "~"), lambda: t.pop(k)])()
    return "".join(t)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(150):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert d.myers(d.peq(a), len(a), b)[0] == distance(a, b)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 2000)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    items = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(12)] + ["tiny one"]
    texts = list(EDGE)
    for i, item in enumerate(items):
        e = d.budget(len(item))
        for n in (0, e, e + 1, 2 * e + 2):
            texts.append(" ".join(word() for _ in range(30)) + " " + edited(rng, item, n).upper().replace(" ", "\n ") + " " + word())
    table = docs(spark, texts)
    bench = spark.createDataFrame([(i, t, 5) for i, t in enumerate(items)] + [(90, None, 1), (91, " ", 1)], ITEM)
    want = set()
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            n = distance(item, d.normal(t)) if len(item) >= d.SHORT else (0 if item in d.normal(t) else 99)
            if n <= d.budget(len(item)):
                want.add((i, k, n))
    rows = d.leaks(spark, table, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in rows} == want and len(want) >= 24
    kept = d.clean(spark, table, bench)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {w[0] for w in want}


def test_edge_tables(spark):
    none, bench = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a text of thirty-two characters, or more", 0)] * 2, ITEM)
    assert d.leaks(spark, none, bench).count() == 0
    assert d.leaks(spark, docs(spark, EDGE), bench.limit(0)).count() == 0
    assert d.clean(spark, docs(spark, EDGE), bench.limit(0)).count() == len(EDGE)
    unknown = spark.createDataFrame([(None, "so, a text of thirty-two characters, or more!", None, None, None, None, None)], DOC)
    assert {r["doc_id"] for r in d.leaks(spark, unknown, bench).collect()} == {None}
