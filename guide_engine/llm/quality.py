"""Quality by positive-unlabelled learning: trusted good texts against unlabelled web text (see ``nnpu``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import nnpu


def op5_query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return nnpu.run(spark, docs, labels, "quality")
