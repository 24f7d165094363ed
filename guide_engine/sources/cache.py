"""The channel-day cache: a Parquet table partitioned by site, channel and day, with entry meta beside it.

Dates keep their offset and precision. Presence comes from the meta table, so an empty day differs from a missing one, and rows
without meta (of a write that broke off) don't count. Writes replace whole channel-days; days are pruned by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

KEYS = ["site", "channel_id", "day"]
META = "site string, channel_id string, day date, grabbed_at string, programme_count int"


class Cache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.rows, self.meta = spark, f"{root}/programmes", f"{root}/entries"

    def _read(self, path: str, ddl: str) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(path)

    def programmes(self) -> DataFrame:
        """The rows of all entries that are there."""
        rows = self._read(self.rows, f"seq long, {schema.ddl(schema.PROGRAMME)}, site string, channel_id string, day date")
        return rows.join(self.entries().select(*KEYS), KEYS, "left_semi")

    def _meta(self) -> DataFrame:
        return self._read(self.meta, "grabbed_at string, programme_count int, site string, channel_id string, day date")

    def entries(self) -> DataFrame:
        """Entry meta; an entry whose time or count can't be read counts as missing."""
        return self._meta().where(F.expr("try_cast(grabbed_at as timestamp)").isNotNull() & F.col("programme_count").isNotNull()).select(*KEYS, "grabbed_at", "programme_count")

    def sweep(self) -> int:
        """Remove entries whose meta can't be read; their number."""
        broken = self._meta().select(*KEYS).join(self.entries(), KEYS, "left_anti")
        n = broken.count()
        self.delete(broken)
        return n

    def write(self, rows: DataFrame, entries: DataFrame) -> None:
        """``entries`` names the channel-days (site, channel_id, day, grabbed_at); ``rows`` may have none for some.

        Counts are made from the rows. The old entries go first and the new meta comes last: a write that breaks off leaves
        channel-days missing, and none with another run's rows. Other channel-days are not touched.
        """
        counts = rows.groupBy(*KEYS).agg(F.count("*").cast("int").alias("n"))
        meta = entries.join(counts, KEYS, "left").select(*KEYS, "grabbed_at", F.coalesce("n", F.lit(0)).alias("programme_count"))
        columns = ["seq", *schema.PROGRAMME, *KEYS]
        self.delete(entries)
        for df, path in ((rows.select(*columns), self.rows), (meta, self.meta)):
            # one task a channel-day: a file each, however many the source's partitions
            df.repartition(*KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)

    def _folders(self, keys: DataFrame):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for r in keys.select(*KEYS).distinct().toLocalIterator():
            for root in (self.rows, self.meta):
                path = jvm.org.apache.hadoop.fs.Path("/".join([root, *(f"{k}={escape(str(r[k]))}" for k in KEYS)]))
                yield path.getFileSystem(conf), path

    def delete(self, keys: DataFrame) -> None:
        for store, path in self._folders(keys):
            store.delete(path, True)

    def prune(self, before: Column) -> int:
        """Remove the days before one; the number of channel-days removed."""
        old = self.entries().where(F.col("day") < before).select(*KEYS)
        n = old.distinct().count()
        self.delete(old)
        return n
