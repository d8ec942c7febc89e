"""Before and after reranking: rank movement, case selection, failures and their causes, mined mismatches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.functions import text as X
from rankmill.operators.metrics import evaluate_pair


def rank_deltas(stage1: DataFrame, stage2: DataFrame, qrels: DataFrame, queries: DataFrame, corpus: DataFrame, long_over: int = 512) -> DataFrame:
    """One row per (query, document) of either run with both ranks, their difference and the texts' facts; a rank is null where a run lacks the document."""
    a = stage1.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank_stage1"))
    b = stage2.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank_ce"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    known = both.join(qrels.where("relevance > 0").select("query_id", "doc_id", F.lit(True).alias("rel")), ["query_id", "doc_id"], "left")
    texts = known.join(queries.select("query_id", F.col("query_raw").alias("q")), "query_id", "left").join(corpus.select("doc_id", F.col("title").alias("t"), "n_tokens"), "doc_id", "left")
    return texts.select(
        "query_id", X.blank_null(F.col("q")).alias("query"), "doc_id", X.blank_null(F.col("t")).alias("doc_title"), "rank_stage1", "rank_ce",
        (F.col("rank_stage1") - F.col("rank_ce")).alias("delta"), F.coalesce("rel", F.lit(False)).alias("is_relevant"), F.coalesce(F.col("n_tokens") > long_over, F.lit(False)).alias("was_truncated"),
    )


def ndcg_deltas(stage1: DataFrame, stage2: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """query_id, both nDCG values and ndcg_delta, of queries with a positive judgment that both runs have."""
    return evaluate_pair(stage1, stage2, qrels, k).select("query_id", F.col("stage1").alias("ndcg_stage1"), F.col("stage2").alias("ndcg_ce"), F.col("delta").alias("ndcg_delta"))


def select_cases(deltas: DataFrame, ndcg: DataFrame, queries: DataFrame, digits: int = 9) -> DataFrame:
    """Five cases of five different queries: case, query_id, note, query_raw.

    The rules take turns and a query is claimed once. Each rule keeps its five best queries
    and at most four can be claimed before it, so its pick is among them: one union of 25 rows at most is
    folded in order of the rules. Ties go to the smaller query_id, then doc_id.
    """
    d, s1, ce = F.col("delta"), F.col("rank_stage1"), F.col("rank_ce")

    def ranked(df: DataFrame, i: int, name: str, value, note) -> DataFrame:
        per_query = df.groupBy("query_id").agg(F.min(F.struct(value.alias("v"), *([F.col("doc_id")] if "doc_id" in df.columns else []), note.alias("note"))).alias("x"))
        return per_query.select(F.lit(i).alias("i"), F.lit(name).alias("case"), "query_id", F.col("x.v").cast("double").alias("v"), F.col("x.note").alias("note")).orderBy("v", "query_id").limit(5)

    moved = F.format_string("doc %s moved rank %d->%d", "doc_id", "rank_stage1", "rank_ce")
    near = deltas.where((s1 <= 5) | (ce <= 5)).where(d.isNotNull()).groupBy("query_id").agg(F.max(F.abs(d)).alias("m"))
    short = queries.where(X.has_abbreviation(F.col("query_raw"))).select("query_id")
    far = deltas.where(d.isNotNull()).join(short, "query_id", "left_semi").groupBy("query_id").agg(F.max(F.abs(d)).alias("m"))
    bad = ndcg.where(F.round("ndcg_delta", digits) < 0)
    rules = [
        ranked(deltas.where(F.col("is_relevant") & (s1 > 5) & (ce <= 3)), 1, "relevant_promoted", -d, moved),
        ranked(deltas.where(~F.col("is_relevant") & (s1 <= 3) & (ce > 5)), 2, "irrelevant_demoted", d, moved),
        ranked(near.where("m <= 1"), 3, "minimal_change", F.col("m"), F.format_string("max |delta| in top-5 = %d", "m")),
        ranked(bad, 4, "failure", F.round("ndcg_delta", digits), F.format_string("nDCG@5 dropped by %.3f", F.abs(F.col("ndcg_delta")))),
        ranked(far, 5, "terminology_abbreviation", -F.col("m"), F.format_string("query contains abbreviation, max |delta| = %d", "m")),
    ]
    few = rules[0]
    for r in rules[1:]:
        few = few.unionByName(r)
    row = "struct(x.i AS i, x.`case` AS `case`, x.query_id AS query_id, x.note AS note)"
    fold = f"""aggregate(array_sort(xs), cast(array() AS array<struct<i:int,case:string,query_id:string,note:string>>),
        (acc, x) -> IF(exists(acc, a -> a.i = x.i OR a.query_id = x.query_id), acc, concat(acc, array({row}))))"""
    picked = few.agg(F.collect_list(F.struct("i", "v", "query_id", "case", "note")).alias("xs")).select(F.explode(F.expr(fold)).alias("c")).select("c.case", "c.query_id", "c.note")
    return picked.join(queries.select("query_id", "query_raw"), "query_id", "left").select("case", "query_id", "note", "query_raw")


def worst(deltas: DataFrame, n: int = 5, delta: str = "delta", digits: int = 9) -> DataFrame:
    """The ``n`` lowest deltas, ties to the smaller query_id; a delta needn't be negative."""
    return deltas.orderBy(F.round(delta, digits), "query_id").limit(n)


def classify_failures(failures: DataFrame, deltas: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, query, causes, evidence and n_automated_causes of each failed query.

    Truncation looks at the relevant document of best first-stage rank, else the best
    first-stage document; negation at the non-relevant document that reranking put highest.
    Documents without a rank come last.
    """
    own = deltas.join(failures.select("query_id"), "query_id", "left_semi")
    far = F.lit(2**31 - 1)
    target = own.groupBy("query_id").agg(F.min(F.struct((~F.col("is_relevant")).alias("o"), F.coalesce("rank_stage1", far).alias("r"), "doc_id", "was_truncated")).alias("t"))
    wrong = own.where("NOT is_relevant").groupBy("query_id").agg(F.min(F.struct(F.coalesce("rank_ce", far).alias("r"), "doc_id")).alias("w"))
    texts = failures.select("query_id").join(queries.select("query_id", "query_raw"), "query_id", "left").join(target, "query_id", "left").join(wrong, "query_id", "left")
    full = texts.withColumn("wrong_id", F.col("w.doc_id")).join(corpus.select(F.col("doc_id").alias("wrong_id"), F.col("text_raw").alias("wrong_text")), "wrong_id", "left")
    q = X.blank_null(F.col("query_raw"))
    found = full.withColumn("neg", X.negation(q, F.col("wrong_text")))
    cut, short, neg = F.coalesce("t.was_truncated", F.lit(False)), X.has_abbreviation(q), F.col("neg.cue").isNotNull()
    causes = F.concat_ws(", ", F.when(cut, "long_document_truncation"), F.when(short, "abbreviation_ambiguity"), F.when(neg, "negation_context_misreading"))
    said = F.concat_ws(" | ", F.when(cut, F.concat(F.lit("doc "), F.col("t.doc_id"), F.lit(" was_truncated=True"))), F.when(short, F.concat(F.lit("query contains abbreviation(s): "), X.abbreviations(q))),
                       F.when(neg, F.concat(F.lit("negation cue '"), F.col("neg.cue"), F.lit("' near query term(s): "), F.array_join("neg.words", ", "))))
    manual, none = F.lit("topic_or_entity_mismatch (requires manual annotation)"), F.lit("none of the automated checks fired")
    return found.select("query_id", q.alias("query"), F.when(causes == "", manual).otherwise(causes).alias("causes"), F.when(said == "", none).otherwise(said).alias("evidence"), (cut.cast("int") + short.cast("int") + neg.cast("int")).alias("n_automated_causes"))


def cause_histogram(classified: DataFrame) -> DataFrame:
    return classified.select(F.explode(F.split("causes", ", ")).alias("cause")).groupBy("cause").agg(F.count("*").alias("count"))


def truncated_failures(classified: DataFrame) -> DataFrame:
    """Of the failed queries, how many show truncation."""
    shown = F.col("causes").contains("long_document_truncation")
    return classified.agg(F.count_if(shown).alias("n_truncated"), F.count("*").alias("n_failures"))


def grid_gap(grid: DataFrame, better: str, other: str, metric: str = "ndcg") -> DataFrame:
    """One row: how far one model leads another at the smallest and at the largest pool that both have, and whether its lead widens."""
    of = lambda model: F.max(F.when(F.col("model") == model, F.col(metric)))
    by_k = grid.groupBy("k").agg((of(better) - of(other)).alias("gap")).where("gap IS NOT NULL")
    row = by_k.agg(F.min("k").alias("k_min"), F.max("k").alias("k_max"), F.min_by("gap", "k").alias("gap_at_min"), F.max_by("gap", "k").alias("gap_at_max"))
    return row.withColumn("widens", F.col("gap_at_max") > F.col("gap_at_min"))


def truncated_relevant(deltas: DataFrame) -> DataFrame:
    """Number of (query, relevant document) rows whose document is long."""
    return deltas.agg(F.coalesce(F.sum(F.when(F.col("is_relevant") & F.col("was_truncated"), 1).otherwise(0)), F.lit(0)).alias("n_relevant_truncated"))


def lexical_mismatch(bm25: DataFrame, dense: DataFrame, qrels: DataFrame, queries: DataFrame, corpus: DataFrame, top_n: int | None = 5, high: int = 5, low: int = 15, depth: int = 100) -> DataFrame:
    """Relevant documents that dense retrieval ranks ``high`` or better and BM25 beyond ``low`` or not at all; in order of ids."""
    ranks = lambda run, name: run.groupBy("query_id", "doc_id").agg(F.min("rank").alias(name))
    rows = qrels.where("relevance > 0").select("query_id", "doc_id").join(ranks(dense, "dense_rank").where(F.col("dense_rank") <= high), ["query_id", "doc_id"]).join(ranks(bm25, "rank"), ["query_id", "doc_id"], "left")
    picked = rows.where(F.col("rank").isNull() | (F.col("rank") > low)).withColumn("bm25_rank", F.coalesce(F.col("rank").cast("string"), F.lit(f"not in top-{depth}")))
    told = _texts(picked, queries, corpus).select("query_id", "query", "doc_id", "doc_title", "bm25_rank", "dense_rank")
    return told if top_n is None else told.orderBy("query_id", "doc_id").limit(top_n)


def semantic_drift(dense: DataFrame, qrels: DataFrame, queries: DataFrame, corpus: DataFrame, top_n: int | None = 5, high: int = 3) -> DataFrame:
    """Documents without a positive judgment among the first ``high`` of dense retrieval, unjudged queries included."""
    rows = dense.where(F.col("rank") <= high).join(qrels.where("relevance > 0"), ["query_id", "doc_id"], "left_anti").withColumnRenamed("rank", "dense_rank")
    told = _texts(rows, queries, corpus).select("query_id", "query", "doc_id", "doc_title", "dense_rank")
    return told if top_n is None else told.orderBy("query_id", "dense_rank").limit(top_n)


def _texts(rows: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    named = rows.join(queries.select("query_id", F.coalesce("query_raw", F.lit("")).alias("query")), "query_id")
    return named.join(corpus.select("doc_id", F.col("title").alias("t")), "doc_id", "left").withColumn("doc_title", X.blank_null(F.col("t")))


def case_evidence(deltas: DataFrame, cases: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` rows of each selected case's query, by rerank then first-stage rank, nulls last."""
    from rankmill.operators.runs import rank_rows

    own = deltas.join(cases.select("query_id", "case"), "query_id")
    return rank_rows(own, [F.asc_nulls_last("rank_ce"), F.asc_nulls_last("rank_stage1"), F.asc("doc_id")], n, "row")
