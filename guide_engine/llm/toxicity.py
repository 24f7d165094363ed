"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic texts against unlabelled text (see ``nnpu``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nnpu


def op9_query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return nnpu.run(spark, docs, labels, "toxicity")


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; null ids stay if their text does."""
    column, words, style, cut = nnpu.TASKS["toxicity"]
    positive, unlabelled = nnpu.samples(docs, labels, column, nnpu.crc_label_fold() != 0)
    return nnpu.keep_below(spark, docs, nnpu.train(positive, unlabelled, words, style), style, cut)
