"""Steps whose cost must not grow faster than their input, on data that makes naive forms slow or large."""

import random
import time

from pyspark.sql import functions as F

from guide_engine.operators import fold, fusion, match


def test_distinct_union_of_a_long_list(spark):
    n = 40_000
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: (x * 7 % (n // 2)).cast("string")).alias("x"))
    began = time.time()
    got = rows.select(fusion.distinct_by(F.col("x"), lambda x: F.struct(x)).alias("x")).first()["x"]
    assert time.time() - began < 30
    assert got == [str(i * 7 % (n // 2)) for i in range(n // 2)]


def test_distinct_union_without_keys(spark):
    rows = spark.createDataFrame([(1, [None, "b", None, "a", "b"]), (2, []), (3, None), (4, [None])], "k int, x array<string>")
    got = {r["k"]: r["x"] for r in rows.select("k", fusion.distinct_by(F.col("x"), lambda x: x).alias("x")).collect()}
    assert got == {1: ["b", "a"], 2: [], 3: None, 4: []}


def test_sweep_holds_a_few_tolerances_of_time():
    sweep, done, most = fold.Sweep(fold.Rules()), 0, 0
    for st in range(60_000):
        for lot in ((0, 0), (0, 1)):
            done += sum(1 for _ in sweep.put(fold.Met(st, None, frozenset("x"), lot, 0, (0, lot[1], st, st, 1))))
        most = max(most, sum(map(len, sweep.held.values())) + sum(map(len, sweep.waiting.values())))
    assert done + sum(1 for _ in sweep.advance()) == 60_000
    assert most < 8_000


def test_pooled_fold_equals_the_fold_of_a_channel(spark):
    rng, rows = random.Random(7), []
    for c in range(6):
        skipped = {d for d in range(5) if rng.random() < 0.25}
        for d in set(range(5)) - skipped:
            for source in range(3):
                for seq in range(rng.randint(0, 60)):
                    st = d * fold.DAY + rng.randrange(-7200, 93_000) // rng.choice([1, 300]) * rng.choice([1, 300])
                    rows.append((f"c{c}", d, d * fold.DAY, source, seq, len(rows), st, st + rng.choice([-5, 20, 250, 40_000]) if rng.random() < 0.7 else None, rng.choice([None, [], ["a"], ["b"], ["a", "b"]])))
    df = spark.createDataFrame(rows, "channel string, day_idx int, midnight long, source int, seq long, id long, st long, sp long, titles array<string>")
    for rules in (fold.Rules(), fold.Rules(merge=False)):
        want = {tuple(r) for r in fold._by_channel(fold._extended(df), rules, None, fold.DAY).collect()}
        assert {tuple(r) for r in fold.fold(df, rules).collect()} == want and len(want) == len(rows)


def test_rows_that_never_meet_need_no_python(spark):
    df = spark.createDataFrame([], "channel string, day_idx int, midnight long, source int, seq long, id long, st long, sp long, titles array<string>")
    plan = fold.ordered(fold.groups(df, fold.Rules(merge=False)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_nearest_pairs_equal_nearest_of_all_pairs_and_make_none(spark):
    rng = random.Random(3)
    sides = []
    for size in (900, 700):
        rows = [(f"c{rng.randrange(2)}", k, st := rng.randrange(4000) // 3 * 3, rng.choice([None, st - 5, st, st + rng.randrange(1, 40), st + 900])) for k in rng.sample(range(5000), size)]
        sides.append(spark.createDataFrame(rows, "channel string, id long, st long, sp long").withColumn("title", F.lit("x")))
    for tolerance in (0, 7, 60):
        want = match.nearest(match.band_pairs(*sides, tolerance, "never"))
        cols = ["channel", "b_id", "a_id", "a_st", "b_st"]
        got = sorted(map(tuple, match.nearest_pairs(*sides, tolerance).select(cols).collect()))
        assert got and got == sorted(map(tuple, want.select(cols).collect()))
    # in a dense stretch each instant looks at few rows
    given = [(st, 1 << 60, st) for st in range(200_000)]
    began = time.time()
    assert all(hit[0] == 0 for hit in match._nearest(given, list(range(200_000)), 100_000))
    assert time.time() - began < 10
