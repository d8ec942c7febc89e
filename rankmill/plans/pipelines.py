"""The two-stage pipeline from raw tables to evaluated, compared runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.operators import bm25, metrics, prep, rerank, runs, significance
from rankmill.operators.storage import materialize


@dataclass
class Prepared:
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def prepare(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, with_title: bool = True) -> Prepared:
    """Clean and deduplicate the corpus, keep judged queries and surviving judgments; written once, for all later stages."""
    own = materialize(prep.prepare_corpus(corpus, with_title), "corpus")
    return Prepared(own, materialize(prep.prepare_queries(queries, qrels), "queries"), materialize(prep.prepare_qrels(prep.one_judgment(qrels), own), "qrels"))


def first_stage(p: Prepared, dense_run: DataFrame | None = None, depth: int = 100, rrf_k: int = 60) -> dict[str, DataFrame]:
    """Runs at full depth, once; smaller pools are their prefixes. With a dense run, also the fusion of both."""
    lexical = materialize(bm25.search(p.corpus, p.queries, bm25.build(p.corpus), depth), "bm25")
    out = {"bm25": lexical}
    if dense_run is not None:
        out |= {"dense": dense_run, "hybrid": materialize(runs.reciprocal_rank_fusion([lexical, dense_run], rrf_k, depth).withColumnRenamed("rrf", "score"), "hybrid")}
    return out


def second_stage(p: Prepared, pool: DataFrame, scorer: rerank.PairScorer, k: int = 20) -> DataFrame:
    return materialize(rerank.rerank(pool, p.queries, p.corpus, scorer, k), "reranked")


def evaluate_stages(p: Prepared, pool: DataFrame, reranked: DataFrame, k: int = 20, cutoff: int = 5) -> dict[str, DataFrame]:
    """Aggregated metrics of both stages, their comparison, signed-rank test and bootstrap interval."""
    asked = p.queries.select("query_id")
    one = metrics.evaluate(pool.where(F.col("rank") <= k), p.qrels, cutoff, asked)
    two = metrics.evaluate(reranked, p.qrels, cutoff, asked)
    pairs = materialize(metrics.paired(one, two), "pairs")
    both = metrics.aggregate(one).withColumn("method", F.lit("stage1")).unionByName(metrics.aggregate(two).withColumn("method", F.lit("stage2")))
    return {"metrics": both, "comparison": metrics.compare(pairs), "wilcoxon": significance.wilcoxon(pairs), "bootstrap": significance.bootstrap_hash(pairs.withColumn("row", F.xxhash64("query_id") % F.lit(1 << 31)).withColumn("row", F.abs("row")))}
