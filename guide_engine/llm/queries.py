"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, decontaminate, minhash, packing, pii, quality, sharding, suffix_dedup, toxicity
from .common import documents
from .oracles import ORACLE_SQL  # noqa: F401


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shards": lambda s, d: sharding.op1_query(s, documents(s, d)),
    "op2_pigeonhole_leaks": lambda s, d: decontaminate.leaks(s, documents(s, d), s.read.parquet(f"{d}/benchmark.parquet")),
    "op3_suffix_doubling": lambda s, d: suffix_dedup.op3_query(s, documents(s, d)),
    "op4_minhash_bbit": lambda s, d: minhash.op4_query(s, documents(s, d)),
    "op5_quality_pu": lambda s, d: quality.op5_query(s, documents(s, d), _labels(s, d)),
    "op6_chat_repair": lambda s, d: chat.op6_query(s, s.read.parquet(f"{d}/conversations.parquet")),
    "op7_pii_bilstm_crf": lambda s, d: pii.find(s, documents(s, d)),
    "op8_pack_spf": lambda s, d: packing.pack_documents(s, documents(s, d)),
    "op9_toxicity_nnpu": lambda s, d: toxicity.op9_query(s, documents(s, d), _labels(s, d)),
    "op10_ann_kmeans_tree": lambda s, d: ann.nearest(s, s.read.parquet(f"{d}/embeddings.parquet")),
}
