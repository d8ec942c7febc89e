"""Runs in long form (query_id, doc_id, rank, score): top-k per query, reciprocal rank fusion, packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.operators.skew import rank_in_groups


def rank_rows(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank", by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The first ``k`` rows of each query, numbered from 1. The window's group limit cuts each partition to k rows a query before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def runs_of_stages(runs: DataFrame, stages: Sequence[str], depth: int | None = None) -> DataFrame:
    """stage, query_id, doc_id, rank and score of clean runs out of logged results, in one pass: each document once, at its best valid score; ranked by score, logged rank, id.

    The whole ranking of each query, of any length (``rank_in_groups``), or with ``depth`` its first places only.
    """
    valid = runs.where(F.col("stage").isin(*stages) & F.col("query_id").isNotNull() & F.col("doc_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    once = valid.groupBy("stage", "query_id", "doc_id").agg(F.max("score").alias("score"), F.min("rank").alias("logged"))
    if depth is None:
        ranked = rank_in_groups(once, ["stage", "query_id"], "score", then=["logged", "doc_id"])
    else:
        ranked = rank_rows(once, [F.desc("score"), F.asc_nulls_last("logged"), F.asc("doc_id")], depth, by=["stage", "query_id"])
    return ranked.select("stage", "query_id", "doc_id", F.col("rank").cast("int").alias("rank"), "score")


def run_of_stage(runs: DataFrame, stage: str, depth: int | None = None) -> DataFrame:
    """query_id, doc_id, rank and score of one stage; see ``runs_of_stages``."""
    return runs_of_stages(runs, [stage], depth).drop("stage")


def reciprocal_rank_fusion(runs: Sequence[DataFrame], k: int = 60, top_k: int = 20, digits: int = 12) -> DataFrame:
    """query_id, doc_id, rrf and rank of the fused ranking of any number of runs; see ``fuse_lists``."""
    tagged = [r.select("query_id", "doc_id", "rank", F.lit(i).alias("list")) for i, r in enumerate(runs)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    return fuse_lists(union, "list", range(len(runs)), k, top_k, digits)


def fuse_lists(ranked: DataFrame, which: str, lists: Sequence, k: int = 60, top_k: int = 20, digits: int = 12) -> DataFrame:
    """query_id, doc_id, rrf and rank of the fusion of the ``lists`` that the column ``which`` tells apart.

    One aggregation stands for the outer join. Equal sums keep the order in which
    the documents are first seen: by rank in the first list that has them, list by list. Sums
    are rounded to ``digits`` before they are compared, as their order of addition is free.
    """
    places = [F.min(F.when(F.col(which) == x, F.col("rank"))).alias(f"rank_{i}") for i, x in enumerate(lists)]
    fused = ranked.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), digits).alias("rrf"), *places)
    order = [F.desc("rrf"), *[F.asc_nulls_last(f"rank_{i}") for i in range(len(places))], F.asc("doc_id")]
    return rank_rows(fused, order, top_k).select("query_id", "doc_id", "rrf", "rank")


def pack(run: DataFrame) -> DataFrame:
    """(query_id, docs): the ranking as an array in order of rank."""
    return run.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))


def unpack(packed: DataFrame, stage: str) -> DataFrame:
    """Rows (query_id, doc_id, rank from 1, stage) of packed rankings; empty rankings give none."""
    return packed.select("query_id", F.posexplode("docs").alias("pos", "doc_id")).select("query_id", "doc_id", (F.col("pos") + 1).alias("rank"), F.lit(stage).alias("stage"))
