"""The queries that SQL can state, against it; the curve and the runs of op1 and the places of op8 against naive forms."""

import zlib

import duckdb
import numpy as np
import pytest
from helpers import EDGE, docs
from test_oracle import rows_of

from guide_engine.llm import packing, queries, sharding

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    done = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in done.description]
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    want = rows_of(names, done.fetchall())
    assert want and rows_of(got.columns, [tuple(r) for r in got.collect()]) == want


def test_runs_of_the_curve_by_brute_force(spark):
    texts = EDGE + [f"w{k} " * (k % 90) for k in range(60)]
    table = docs(spark, texts)
    table = table.union(table.where("doc_id % 3 = 0")).union(table.selectExpr("cast(null as long)", "text", "lang", "source", "n_chars", "pos", "size").where("doc_id is null or n_chars > 100"))
    cell = lambda s: 0 if s is None else zlib.crc32(s.encode()) >> 27
    rows = []
    for r in table.collect():
        raw = (r["text"] or "").encode()
        point = np.array([[cell(r["lang"]), cell(r["source"]), min(31, int(np.log2(len(raw) + 1)))]])
        rows.append((int(sharding.hilbert(point, 5)[0]), zlib.crc32(raw), r["doc_id"] is not None, r["doc_id"] or 0, len(raw) + 1))
    rows.sort()
    n = len(rows)
    starts = [-(-k * n // 8) for k in range(9)]
    want = []
    for p, (_, crc, known, i, size) in enumerate(rows):
        k = p * 8 // n
        want.append((i if known else None, size, crc, k, p - starts[k]))
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.op1_query(spark, table).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    counts = [sum(g[3] == k for g in got) for k in range(8)]
    assert max(counts) - min(counts) <= 1


def naive_packing(lengths, capacity):
    """Longest first, each into the emptiest open sequence it fits in, one piece at a time: how many sequences that takes."""
    room = []
    for n in sorted(lengths, reverse=True):
        best = max(range(len(room)), key=lambda k: room[k], default=None)
        if best is not None and room[best] >= n:
            room[best] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_plan_of_packs_against_piece_by_piece_placement():
    rng = np.random.default_rng(4)
    for capacity in (7, 16, 64):
        for _ in range(40):
            histogram = {int(n): int(c) for n, c in zip(rng.integers(1, capacity + 1, 6), rng.integers(1, 30, 6))}
            runs, made = packing.plan(histogram, capacity)
            lengths = [n for n, c in histogram.items() for _ in range(c)]
            held = {}
            for n, own in runs.items():
                ranks = [r for r, _, _ in own] + [histogram[n]]
                assert ranks == sorted(ranks) and ranks[0] == 0
                for (rank, seq, off), stop in zip(own, ranks[1:]):
                    for k in range(stop - rank):
                        held.setdefault(seq + k, []).append((off, n))
            assert sorted(held) == list(range(made)) and sum(map(len, held.values())) == len(lengths)
            for places in held.values():
                at = 0
                for off, n in sorted(places):  # gapless from 0, within the capacity
                    assert off == at
                    at += n
                assert at <= capacity
            assert made <= max(naive_packing(lengths, capacity), -(-sum(lengths) // capacity)) * 1.1 + 1
