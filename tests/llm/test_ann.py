import numpy as np

from guide_engine.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def brute(rows, k=5, every=50):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in good:
        if q % every == 0:
            scored = sorted((-float((good[c] * good[q]).sum() / (np.sqrt((good[c] ** 2).sum()) * np.sqrt((good[q] ** 2).sum()))), c) for c in good if c != q)
            out[q] = [(c, -s) for s, c in scored[:k]]
    return out


def run(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 0, 9.0) for i, v in rows], SCHEMA)
    got = {}
    for r in sorted(ann.nearest(spark, frame, **more).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 32))
    rows = [(i, [float(x) for x in centres[i % 10] + 0.8 * rng.normal(size=32)]) for i in range(6000)]
    want, got = brute(rows), run(spark, rows)
    assert got.keys() == want.keys()
    found = [len({c for c, _ in got[q]} & {c for c, _ in want[q]}) / 5 for q in want]
    assert np.mean(found) >= 0.9
    for q in want:
        scores = dict(want[q])
        assert all(abs(s - scores[c]) < 1e-12 for c, s in got[q] if c in scores)


def test_copies_tie_by_id_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 64)
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(x) for x in rng.normal(size=3)]) for i in range(900)]
    want, got = brute(rows, every=25), run(spark, rows, every=25, target=1.0)
    assert got.keys() == want.keys() and all(got[q] == want[q] for q in want if q % 3)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (None, [1.0, 0.0]), (50, None), (6, [1.0, 1.0]), (100, [0.5, 0.1]), (7, [1.0])]
    want = brute([r for r in rows if r[0] != 7])
    got = run(spark, rows)
    assert {q: [c for c, _ in x] for q, x in got.items()} == {q: [c for c, _ in x] for q, x in want.items()}
    assert run(spark, []) == {} and run(spark, [(1, [1.0])]) == {} and run(spark, [(0, [1.0])]) == {} and run(spark, [(0, None)]) == {}


def test_repeated_ids_take_one_place(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)]
    some = [rows[3]] * 40 + [rows[100]] * 40
    want = brute(rows)
    assert all(len(x) == 5 for x in want.values())
    for table in (rows + rows, rows * 7, rows + some):
        got = run(spark, table, target=1.0)
        assert {q: [c for c, _ in x] for q, x in got.items()} == {q: [c for c, _ in x] for q, x in want.items()}


def test_best_of_an_id_counts():
    x = np.array([[1.0, 0.0], [1.0, 0.1], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, 0.0], [1.0, 0.0]])
    ids = np.array([9, 7, 7, 5, 4, 7, 7])
    q = np.array([1.0, 0.0])
    got, score, rows = ann.best(9, q, ann._unit(x) @ q, ids, x, 3)
    assert got.tolist() == [7, 4, 5] and abs(score[0] - 1) < 1e-12 and ids[rows].tolist() == got.tolist()


def test_walk_goes_on_until_enough_ids_are_covered():
    x = np.concatenate([np.eye(4)[i] + 0.01 * np.random.default_rng(i).normal(size=(40, 4)) for i in range(4)])
    tree = ann.Tree(ann._unit(x), 8)
    held = np.bincount(tree.leaves_of(ann._unit(x)), minlength=tree.n_leaves)
    for q in ann._unit(x)[::10]:
        path = tree.visits(q, 1, held, 60)
        assert held[path].sum() >= 60 > held[path[:-1]].sum() and path[:1] == tree.visits(q, 1)
    assert sorted(tree.visits(x[0], 1, held, 1000)) == list(range(tree.n_leaves))


def test_queries_in_small_leaves_find_k(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 4)
    centres = np.eye(16)
    rows = [(i, centres[i % 8].tolist()) for i in range(1, 2000)]
    rows += [(0, [0.0] * 15 + [1.0]), (2001, [0.0] * 14 + [0.1, 1.0])]
    got = run(spark, rows, target=0.9)
    assert len(got) == 40 and all(len(x) == 5 for x in got.values()) and got[0][0][0] == 2001
    few = [(i, v) for i, v in rows if i % 500 in (0, 1, 2)][:4]
    assert all(len(x) == 3 for x in run(spark, few).values())
