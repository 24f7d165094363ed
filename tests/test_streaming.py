from test_oracle import DIR

from guide_engine import catalogue
from guide_engine.operators import fold
from guide_engine.streaming import fold_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = catalogue.guide_rows(spark, DIR).cache()
    want = sorted(map(tuple, fold.fold(rows).collect()))
    src, cols = str(tmp_path / "in"), [c.split()[0] for c in fold_stream.ROW.split(", ")]
    data = rows.selectExpr(*[c if c != "kind" else "'row' as kind" for c in cols])
    for k, (a, b) in enumerate(((0, 9), (10, 19), (20, 99))):
        data.where(f"day_idx between {a} and {b}").coalesce(1).write.parquet(f"{src}/{k}")
    ends = rows.select("channel").distinct().selectExpr(*[{"channel": "channel", "kind": "'end' as kind"}.get(c.split()[0], f"cast(null as {c.split()[1]}) as {c.split()[0]}") for c in fold_stream.ROW.split(", ")])
    ends.coalesce(1).write.parquet(f"{src}/3")
    stream = spark.readStream.schema(fold_stream.ROW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    q = fold_stream.fold_stream(stream).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("folded").collect())) == want
