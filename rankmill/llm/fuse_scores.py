"""Problem 3: one ranking from several differently-scaled scores, by reciprocal rank fusion.

Only ranks enter the result, so no score outweighs another through its range. Groups of any
size are ranked by range partitions (rankmill.operators.skew.rank_in_groups).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.operators.skew import HOT_SHARE, lookup, rank_in_groups
from rankmill.operators.storage import materialize

RRF_K = 60
#: Items that one task folds into a champion.
FOLD = 1000


def valid(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score)


def fuse(pool: DataFrame, group: str, item: str, scores: Sequence[str], k: int = RRF_K) -> DataFrame:
    """``group``, ``item``, the ``scores`` and ``rrf``: the sum over the scores of 1 / (k + rank in the group).

    ``pool`` has one row per (group, item), with doubles. Equal scores share a rank. A null or
    NaN score adds nothing to the sum; rows without a group or item are left out; an empty
    pool stays empty. Sort by falling ``rrf``, then ``item``, for the one ranking.
    """
    rows = pool.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    lists = F.array(*[F.struct(F.lit(i).alias("l"), F.when(F.col(s) == 0, 0.0).otherwise(F.col(s)).alias("s")) for i, s in enumerate(scores)])
    long = rows.select(F.col(group).alias("g"), F.col(item).alias("i"), F.explode(lists).alias("x")).select("g", "i", "x.l", "x.s").where(valid(F.col("s")))
    ranked = rank_in_groups(long, ["g", "l"], "s", "r")
    own = [F.max(F.when(F.col("l") == i, F.col("s"))).alias(s) for i, s in enumerate(scores)]
    total = F.sum(1.0 / (k + F.col("r"))).alias("rrf")
    return ranked.groupBy(F.col("g").alias(group), F.col("i").alias(item)).agg(*own, total)


def majority_winner(fused: DataFrame, group: str, item: str, scores: Sequence[str], k: int = RRF_K) -> DataFrame:
    """For each group of two or more items: the item that is strictly higher than each rival in a majority of the scores.

    Of three scores, such an item loses to or ties with each of its m - 1 rivals in at most
    one, so its ranks add up to m + 2 at most, and as 1 / (k + r) is convex its ``rrf`` is at
    least 3 / (k + (m + 2) / 3): only items that the fusion puts there are candidates. A
    knock-out, in which the winner can't lose, leaves one candidate a group, which is then
    held against its whole pool. Groups without such an item have no row.
    """
    if len(scores) != 3:
        raise ValueError("the bound on the candidates' fused score is that of three scores")
    fused = materialize(fused, "fused")
    sizes = materialize(fused.groupBy(group).agg(F.count("*").alias("m")), "sizes")
    total = sizes.agg(F.sum("m")).first()[0] or 0
    hot = F.col("m") >= F.lit(HOT_SHARE * total)
    beats = " + ".join(f"int(x.`{s}` > c.`{s}`)" for s in scores)
    fold = f"aggregate(slice(xs, 2, size(xs)), xs[0], (c, x) -> IF({beats} >= 2, x, c))"
    row = F.struct(F.col(item), *[F.col(s) for s in scores])
    candidates = lookup(fused, sizes, [group], hot).where((F.col("m") >= 2) & (F.col("rrf") >= 3.0 / (k + (F.col("m") + 2) / 3.0) - 1e-12))
    level = candidates.select(group, F.pmod(F.xxhash64(item), F.ceil(F.col("m") / FOLD).cast("long")).alias("__s"), row.alias("x"))
    for _ in range(2):
        level = level.groupBy(group, "__s").agg(F.collect_list("x").alias("xs")).select(group, F.floor(F.col("__s") / FOLD).alias("__s"), F.expr(fold).alias("x"))
    last = level.groupBy(group).agg(F.collect_list("x").alias("xs")).select(group, F.expr(fold).alias("c"))
    last = lookup(last, sizes, [group], hot)
    against = lookup(fused.select(group, row.alias("x")), last, [group], hot)
    won = " + ".join(f"int(c.`{s}` > x.`{s}`)" for s in scores)
    held = against.groupBy(group, F.col(f"c.{item}").alias(item), "m").agg(F.sum(F.expr(f"int({won} >= 2)")).alias("__won"))
    return held.where(F.col("__won") == F.col("m") - 1).select(group, item)


def score_pool(runs: DataFrame, reranked: DataFrame, stages: Sequence[str] = ("bm25", "dense")) -> DataFrame:
    """query_id, doc_id and the highest valid score in each first-stage list and in the reranked one; documents that have them all."""
    first = runs.where(F.col("stage").isin(*stages) & valid(F.col("score")) & F.col("query_id").isNotNull() & F.col("doc_id").isNotNull())
    second = reranked.where(valid(F.col("score")) & F.col("query_id").isNotNull() & F.col("doc_id").isNotNull())
    again = second.groupBy("query_id", "doc_id").agg(F.max("score").alias("rerank"))
    # The reranked pairs are far fewer: others leave before they are aggregated.
    first = first.select("query_id", "doc_id", "stage", "score").join(again.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    own = [F.max(F.when(F.col("stage") == s, F.col("score"))).alias(s) for s in stages]
    wide = first.groupBy("query_id", "doc_id").agg(*own)
    for s in stages:
        wide = wide.where(F.col(s).isNotNull())
    return wide.join(again, ["query_id", "doc_id"])
