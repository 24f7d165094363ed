import zlib

import numpy as np
from helpers import DOC, EDGE, docs

from guide_engine.llm import sharding


def test_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = sharding.hilbert(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_rows_law_slots_and_crc(spark):
    table = docs(spark, EDGE + [f"text {i}" for i in range(40)])
    rows = sharding.op1_query(spark, table).collect()
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), None)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_empty_and_repeated_rows(spark):
    assert sharding.op1_query(spark, spark.createDataFrame([], DOC)).count() == 0
    one = docs(spark, ["a", None])
    rows = sharding.op1_query(spark, one.union(one).union(one.selectExpr("cast(null as long) doc_id", *one.columns[1:]))).collect()
    assert len(rows) == 6 and len({(r["shard"], r["slot"]) for r in rows}) == 6


def test_ranges(spark):
    rows = sharding.shard_runs(spark, docs(spark, EDGE), 3)
    got = sharding.run_ranges(rows).collect()
    assert sum(r["n_rows"] for r in got) == len(EDGE) and all(r["min_size"] <= r["max_size"] for r in got)


def test_written_shards_hold_every_row_once(spark, tmp_path):
    one = docs(spark, EDGE + ["a", None])
    table = one.union(one).union(one.selectExpr("cast(null as long) doc_id", *one.columns[1:]))
    sharding.write_shards(spark, table, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    rows = lambda df: sorted((tuple(r) for r in df.select(*one.columns).collect()), key=repr)
    assert rows(back) == rows(table) and len({(r["shard"], r["slot"]) for r in back.collect()}) == table.count()
