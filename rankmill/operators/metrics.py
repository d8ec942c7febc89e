"""Ranking metrics of whole runs: one aggregation per query, all queries at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ideal(qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, n_relevant, idcg) over the positive judgments; queries without one are absent. Gain is linear."""
    positive = qrels.where(F.col("relevance") > 0)
    placed = positive.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"))))
    gain = F.sum(F.when(F.col("pos") <= k, F.col("relevance") / F.log2(F.col("pos") + 1.0)))
    return placed.groupBy("query_id").agg(F.count("*").alias("n_relevant"), gain.alias("idcg"))


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 5, run_queries: DataFrame | None = None, skip_unjudged: bool = True, mrr_at: int | None = None, method: str | None = None) -> DataFrame:
    """query_id, precision, precision_ceiling, recall, mrr and ndcg at ``k`` for each query of the run.

    Precision divides by k, however short the ranking. The reciprocal rank isn't cut, or counts first hits up to place ``mrr_at`` only. Ideal
    gains are those of all positive judgments; a negative grade lowers the gain of a ranking.
    ``run_queries``: queries of the run, those with an empty ranking included, which score 0.
    Queries without a positive judgment are left out, or score 0 with ``skip_unjudged=False``. A
    document that stands twice in a ranking counts twice. ``method``: a column of the run that tells several runs apart,
    which are then evaluated in one pass; it stands before query_id.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    keys = ["query_id"] if method is None else [method, "query_id"]
    asked = run.select(*keys).distinct() if run_queries is None else run_queries.select(*keys).distinct()
    judged = asked.join(ideal(qrels, k), "query_id", "inner" if skip_unjudged else "left")
    hits = run.select(*keys, "doc_id", "rank").join(qrels, ["query_id", "doc_id"])  # documents without a judgment add nothing
    relevant, near = F.col("relevance") > 0, F.col("rank") <= k
    first = relevant if mrr_at is None else relevant & (F.col("rank") <= mrr_at)
    found = hits.groupBy(*keys).agg(
        F.sum(F.when(near & relevant, 1).otherwise(0)).alias("hits"), F.min(F.when(first, F.col("rank"))).alias("first"),
        F.sum(F.when(near, F.col("relevance") / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    n, zero = F.coalesce("n_relevant", F.lit(0)), F.lit(0.0)
    all_ = judged.join(found, keys, "left")
    return all_.select(
        *keys,
        (F.coalesce("hits", F.lit(0)) / F.lit(k)).alias("precision"),
        (F.least(n, F.lit(k)) / F.lit(k)).alias("precision_ceiling"),
        F.when(n > 0, F.coalesce("hits", F.lit(0)) / n).otherwise(zero).alias("recall"),
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.when(F.col("idcg") > 0, F.coalesce("dcg", zero) / F.col("idcg")).otherwise(zero).alias("ndcg"),
    )


def aggregate(per_query: DataFrame, method: str | None = None) -> DataFrame:
    """One row (for each method, if that column is named): the mean of each metric, precision as a share of its ceiling (a ratio of means), n_queries. Without queries: nulls and 0."""
    names = ["precision", "precision_ceiling", "recall", "mrr", "ndcg"]
    means = per_query.groupBy(*([method] if method else [])).agg(*[F.avg(n).alias(n) for n in names], F.count("*").alias("n_queries"))
    return means.withColumn("precision_pct_of_ceiling", F.when(F.col("precision_ceiling") > 0, F.col("precision") / F.col("precision_ceiling")))


def recall_ceiling(run: DataFrame, qrels: DataFrame, ks: Sequence[int] = (5, 10, 20, 50, 100), run_queries: DataFrame | None = None, method: str | None = None) -> DataFrame:
    """k, recall, n_queries and pct_queries_with_hit: what a reranker of the first k could reach. One pass for all k, and for all runs that the column ``method`` tells apart."""
    keys = ["query_id"] if method is None else [method, "query_id"]
    asked = run.select(*keys).distinct() if run_queries is None else run_queries.select(*keys).distinct()
    positive = qrels.where(F.col("relevance") > 0)
    judged = asked.join(positive.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")
    hits = run.select(*keys, "doc_id", "rank").join(positive, ["query_id", "doc_id"])
    counts = hits.groupBy(*keys).agg(F.array(*[F.struct(F.lit(k).alias("k"), F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("hits")) for k in ks]).alias("by_k"))
    none = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(0).cast("long").alias("hits")) for k in ks])
    each = judged.join(counts, keys, "left").select(*keys[:-1], "n", F.explode(F.coalesce("by_k", none)).alias("x")).select(*keys[:-1], "n", "x.k", "x.hits")
    return each.groupBy(*keys[:-1], "k").agg(F.avg(F.col("hits") / F.col("n")).alias("recall"), F.count("*").alias("n_queries"), F.avg(F.when(F.col("hits") > 0, 100.0).otherwise(0.0)).alias("pct_queries_with_hit"))


def pivot_methods(ceilings: DataFrame, methods: Sequence[str], method: str = "method") -> DataFrame:
    """k and one recall column per method."""
    return ceilings.groupBy("k").pivot(method, list(methods)).agg(F.first("recall"))


def evaluate_pair(baseline: DataFrame, treatment: DataFrame, qrels: DataFrame, k: int = 5, metric: str = "ndcg") -> DataFrame:
    """``paired`` of two runs, evaluated in one pass."""
    both = baseline.select("query_id", "doc_id", "rank", F.lit(1).alias("stage")).unionByName(treatment.select("query_id", "doc_id", "rank", F.lit(2).alias("stage")))
    each = evaluate(both, qrels, k, method="stage")
    of = lambda i: F.max(F.when(F.col("stage") == i, F.col(metric)))
    return each.groupBy("query_id").agg(of(1).alias("stage1"), of(2).alias("stage2")).where("stage1 IS NOT NULL AND stage2 IS NOT NULL").withColumn("delta", F.col("stage2") - F.col("stage1"))


def paired(baseline: DataFrame, treatment: DataFrame, metric: str = "ndcg") -> DataFrame:
    """query_id, stage1, stage2 and delta of the queries that both have."""
    a = baseline.select("query_id", F.col(metric).alias("stage1"))
    return a.join(treatment.select("query_id", F.col(metric).alias("stage2")), "query_id").withColumn("delta", F.col("stage2") - F.col("stage1"))


def compare(pairs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row of counts and means of paired deltas. Raises at run time if no query is shared."""
    d = F.col("delta")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    up, down, n = count(d > tolerance), count(d < -tolerance), F.count("*")
    row = pairs.agg(
        n.alias("n_queries"), F.avg("stage1").alias("baseline_mean"), F.avg("stage2").alias("treatment_mean"), F.avg(d).alias("mean_delta"),
        up.alias("n_improved"), down.alias("n_degraded"), (n - up - down).alias("n_unchanged"), (100.0 * up / n).alias("pct_improved"), (100.0 * down / n).alias("pct_degraded"),
    )
    return row.withColumn("n_queries", F.when(F.col("n_queries") == 0, F.raise_error(F.lit("the runs share no query ids"))).otherwise(F.col("n_queries")))
