"""The registered queries of the retrieval and evaluation operators, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmill.functions import text as X
from rankmill.operators import analysis, bm25, dense, hybrid, metrics, prep, rerank, runs, significance
from rankmill.operators.storage import load, materialize, new_path
from rankmill.sources import io
from rankmill.utils.runtime import summarise

KS = (5, 10, 20, 50, 100)
#: Places of a run that fusion, recall ceilings and mining look at; packing and evaluation take whole runs.
POOL = 100
GRID = (5, 10, 20, 50)
#: Resamples of both bootstraps.
SAMPLES = 10_000


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "corpus")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "queries")


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    return prep.one_judgment(load(spark, d, "qrels"))


def _stage(spark: SparkSession, d: str, stage: str, depth: int | None = None) -> DataFrame:
    return runs.run_of_stage(load(spark, d, "runs"), stage, depth)


def _fused(spark: SparkSession, d: str, top_k: int = 20) -> DataFrame:
    lists = ("bm25", "dense")
    return runs.fuse_lists(runs.runs_of_stages(load(spark, d, "runs"), lists, POOL), "stage", lists, 60, top_k)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("doc_id", "title", F.col("text_raw").alias("abstract"), "corpus_ord")


def _scored(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return rerank.score_pool(_fused(spark, d, k), _queries(spark, d), _corpus(spark, d), rerank.OverlapScorer(), k)


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """First-stage pool and its reranking; written once, as several operators read both."""
    scored = materialize(_scored(spark, d), "scored")
    return scored.select("query_id", "doc_id", F.col("stage1_rank").alias("rank")), rerank.rerank_scored(scored, 20).select("query_id", "doc_id", "rank")


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    one, two = _both(spark, d)
    return analysis.rank_deltas(one, two, _qrels(spark, d), _queries(spark, d), _corpus(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    one, two = _both(spark, d)
    return metrics.evaluate_pair(one, two, _qrels(spark, d))


# --- preparation


def markup_stripped(spark, d):
    return _corpus(spark, d).select("doc_id", X.collapse_space(X.strip_markup(X.blank_null(F.col("text_raw")))).alias("text"))


def clean_text(spark, d):
    return prep.clean_corpus(_raw(spark, d), with_title=False).select("doc_id", "title", "text_raw", "text_norm", "dedup_key")


def prepared_corpus(spark, d):
    return prep.prepare_corpus(_raw(spark, d), with_title=False).select("doc_id", "title", "text_raw", "n_tokens", "has_abbrev")


def dedup_keep_first(spark, d):
    keyed = _corpus(spark, d).select("doc_id", "corpus_ord", X.dedup_key(X.blank_null(F.col("title")), X.blank_null(F.col("text_norm"))).alias("dedup_key"))
    return prep.keep_first(keyed, "dedup_key", "corpus_ord")


def token_stats(spark, d):
    t = F.col("text_raw")
    return _corpus(spark, d).select("doc_id", X.white_tokens(t).alias("n_white"), F.size(X.tokens(t)).alias("n_terms"), F.size(X.content_words(t)).alias("n_content"))


def abbrev_flag(spark, d):
    return _corpus(spark, d).select("doc_id", X.has_abbreviation(F.col("text_raw")).alias("has_abbrev_now"), X.abbreviations(F.col("title")).alias("title_abbrevs"))


def length_summary(spark, d):
    own = _corpus(spark, d).select(X.white_tokens(F.col("text_raw")).alias("n_tokens"))
    return prep.length_summary(own).select(*[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "pct_over")], F.col("max").alias("n_max"), F.col("min").alias("n_min"))


def prep_counters(spark, d):
    corpus = _corpus(spark, d)
    kept = prep.keep_first(corpus.select("doc_id", "corpus_ord", "text_raw", X.dedup_key(X.blank_null(F.col("title")), X.blank_null(F.col("text_norm"))).alias("dedup_key")), "dedup_key", "corpus_ord")
    return prep.prep_counters(_raw(spark, d), kept.select("doc_id", X.has_abbreviation(F.col("text_raw")).alias("has_abbrev"))).withColumn("pct_abbrev", F.round("pct_abbrev", 6))


def queries_semi(spark, d):
    return _queries(spark, d).join(load(spark, d, "qrels").select("query_id").distinct(), "query_id", "left_semi").select("query_id", "query_raw")


def prepared_queries(spark, d):
    return prep.prepare_queries(_queries(spark, d).select("query_id", F.col("query_raw").alias("query_text")), load(spark, d, "qrels"))


def qrels_semi(spark, d):
    return prep.prepare_qrels(load(spark, d, "qrels"), _corpus(spark, d))


def queries_with_several_judgments(spark, d):
    return prep.queries_with_several_judgments(load(spark, d, "qrels"))


def ambiguous_abbrevs(spark, d):
    found = prep.ambiguous_abbreviations(_corpus(spark, d).where("text_raw IS NOT NULL"))
    return found.withColumn("sample_nearby_words", F.array_join("sample_nearby_words", ", "))


# --- first stage


def term_df_idf(spark, d):
    return bm25.build(_corpus(spark, d)).terms.select("term", "df", F.round("idf", 9).alias("idf"))


def bm25_scores(spark, d):
    index = bm25.build(_corpus(spark, d))
    return bm25.scores(_corpus(spark, d), _queries(spark, d), index)


def bm25_topk(spark, d):
    found = bm25.search(_corpus(spark, d), _queries(spark, d), bm25.build(_corpus(spark, d)), 20)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def dense_topk(spark, d):
    vectors = load(spark, d, "embeddings")
    return dense.search(vectors, vectors.where("vec_id % 100 = 0"), 20, "vec_id", "vec_id")


def rrf_hybrid_topk(spark, d):
    return _fused(spark, d).select("query_id", "doc_id", F.round("rrf", 9).alias("rrf"), "rank")


def hybrid_topk(spark, d):
    own = bm25.search(_corpus(spark, d), _queries(spark, d), bm25.build(_corpus(spark, d)), POOL)
    return runs.reciprocal_rank_fusion([own, _stage(spark, d, "dense", POOL)], 60, 20).select("query_id", "doc_id", F.round("rrf", 9).alias("rrf"), "rank")


def hybrid_own_topk(spark, d):
    """Both searches are the library's own; hashed term vectors stand in for an encoder."""
    corpus, queries_ = _corpus(spark, d), _queries(spark, d)
    return hybrid.search(corpus, queries_, bm25.build(corpus)).select("query_id", "doc_id", F.round("rrf", 9).alias("rrf"), "rank")


def packed_runs(spark, d):
    return runs.pack(_stage(spark, d, "hybrid")).select("query_id", F.array_join("docs", " ").alias("docs"))


def unpacked_runs(spark, d):
    return runs.unpack(runs.pack(_stage(spark, d, "hybrid")), "hybrid")


# --- second stage


def rerank_overlap_topk(spark, d):
    return rerank.rerank_scored(_scored(spark, d), 20).select("query_id", "doc_id", "rank", "score", "n_tokens_before_truncation", "was_truncated")


def truncation_rate(spark, d):
    return rerank.truncation_rate(_scored(spark, d)).withColumn("truncation_pct", F.round("truncation_pct", 9))


def pair_trace(spark, d):
    t = rerank.pair_trace(_fused(spark, d), _queries(spark, d), _corpus(spark, d), rerank.OverlapScorer())
    return t.select("query_id", "query", "doc_id", F.array_join("tokens", " ").alias("tokens"), "n_tokens_before_truncation", "was_truncated", "logit")


def model_trace(spark, d):
    """The trace by the ids of a public tokenizer."""
    vocabulary = os.path.join(os.environ.get("RANKMILL_TOKENIZERS", "/opt/tokenizers"), "word_bpe_49k.json")
    return rerank.model_trace(_fused(spark, d), _queries(spark, d), _corpus(spark, d), rerank.OverlapScorer(), vocabulary)


def _grid(spark, d):
    pool = materialize(_fused(spark, d, max(GRID)), "pool")
    scorers = {"overlap": rerank.OverlapScorer(), "density": rerank.DensityScorer()}
    scored = {m: materialize(rerank.score_pool(pool, _queries(spark, d), _corpus(spark, d), s, max(GRID)), "scored") for m, s in scorers.items()}
    return rerank.grid(scored, _qrels(spark, d), pool.select("query_id").distinct(), GRID)


def grid_k(spark, d):
    return _grid(spark, d).select("model", "k", F.round("ndcg", 9).alias("ndcg"), F.round("mrr", 9).alias("mrr"), "n_queries")


def grid_gap(spark, d):
    row = analysis.grid_gap(_grid(spark, d).withColumn("ndcg", F.round("ndcg", 9)), "density", "overlap")
    return row.select("k_min", "k_max", F.round("gap_at_min", 9).alias("gap_at_min"), F.round("gap_at_max", 9).alias("gap_at_max"), "widens")


# --- evaluation

_METRICS = ("precision", "precision_ceiling", "recall", "mrr", "ndcg")


def _rounded(df: DataFrame, names=_METRICS) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, 9))
    return df


def metrics_per_query(spark, d):
    return _rounded(metrics.evaluate(_stage(spark, d, "hybrid"), _qrels(spark, d)))


def metrics_unjudged_too(spark, d):
    return _rounded(metrics.evaluate(_stage(spark, d, "bm25"), _qrels(spark, d), 10, _queries(spark, d).select("query_id"), skip_unjudged=False))


def metrics_mrr_cut(spark, d):
    """Reciprocal ranks of the first five places only."""
    return metrics.evaluate(_stage(spark, d, "bm25"), _qrels(spark, d), mrr_at=5).select("query_id", F.round("mrr", 9).alias("mrr"))


STAGES = ("bm25", "dense", "hybrid")


def metrics_aggregate(spark, d):
    each = metrics.evaluate(runs.runs_of_stages(load(spark, d, "runs"), STAGES), _qrels(spark, d), method="stage")
    return _rounded(metrics.aggregate(each, "stage").withColumnRenamed("stage", "method"), (*_METRICS, "precision_pct_of_ceiling"))


def recall_ceiling(spark, d):
    return _rounded(metrics.recall_ceiling(_stage(spark, d, "hybrid", POOL), _qrels(spark, d), KS), ("recall", "pct_queries_with_hit"))


def recall_ceiling_pivot(spark, d):
    ceilings = metrics.recall_ceiling(runs.runs_of_stages(load(spark, d, "runs"), STAGES, POOL), _qrels(spark, d), KS, method="stage")
    return _rounded(metrics.pivot_methods(ceilings, STAGES, "stage"), STAGES)


def per_query_deltas(spark, d):
    return _rounded(_pairs(spark, d), ("stage1", "stage2", "delta"))


def compare_runs(spark, d):
    return _rounded(metrics.compare(_pairs(spark, d)), ("baseline_mean", "treatment_mean", "mean_delta", "pct_improved", "pct_degraded"))


def wilcoxon_stats(spark, d):
    return _rounded(significance.wilcoxon_sums(_pairs(spark, d), digits=9), ("z",))


def wilcoxon_p(spark, d):
    return _rounded(significance.wilcoxon(_pairs(spark, d), digits=9), ("z", "p_value"))


def bootstrap_hash_ci(spark, d):
    rows = _pairs(spark, d).withColumn("row", F.substring("query_id", 2, 20).cast("long"))
    return significance.bootstrap_hash(rows, SAMPLES)


def bootstrap_replay_ci(spark, d):
    return significance.bootstrap_replay(_pairs(spark, d), SAMPLES)


# --- analysis


def rank_delta_table(spark, d):
    return _deltas(spark, d)


def ndcg_delta(spark, d):
    one, two = _both(spark, d)
    return _rounded(analysis.ndcg_deltas(one, two, _qrels(spark, d)), ("ndcg_stage1", "ndcg_ce", "ndcg_delta"))


def _cases(spark, d):
    one, two = _both(spark, d)
    q = _qrels(spark, d)
    deltas = materialize(analysis.rank_deltas(one, two, q, _queries(spark, d), _corpus(spark, d)), "deltas")
    return deltas, analysis.select_cases(deltas, analysis.ndcg_deltas(one, two, q), _queries(spark, d))


def case_selection(spark, d):
    return _cases(spark, d)[1]


def case_evidence(spark, d):
    return analysis.case_evidence(*_cases(spark, d)).select("case", "query_id", "row", "doc_id", "rank_stage1", "rank_ce", "delta", "is_relevant")


def lexical_mismatch(spark, d):
    return analysis.lexical_mismatch(_stage(spark, d, "bm25", POOL), _stage(spark, d, "dense", POOL), _qrels(spark, d), _queries(spark, d), _corpus(spark, d), None)


def semantic_drift(spark, d):
    return analysis.semantic_drift(_stage(spark, d, "dense", POOL), _qrels(spark, d), _queries(spark, d), _corpus(spark, d), None)


def lexical_mismatch_top5(spark, d):
    return analysis.lexical_mismatch(_stage(spark, d, "bm25", POOL), _stage(spark, d, "dense", POOL), _qrels(spark, d), _queries(spark, d), _corpus(spark, d), 5)


def semantic_drift_top5(spark, d):
    return analysis.semantic_drift(_stage(spark, d, "dense", POOL), _qrels(spark, d), _queries(spark, d), _corpus(spark, d), 5)


def worst5(spark, d):
    return _rounded(analysis.worst(_pairs(spark, d)), ("stage1", "stage2", "delta"))


def _failures(spark, d):
    one, two = _both(spark, d)
    q = _qrels(spark, d)
    deltas = analysis.rank_deltas(one, two, q, _queries(spark, d), _corpus(spark, d))
    pairs = metrics.evaluate_pair(one, two, q)
    return analysis.classify_failures(analysis.worst(pairs), deltas, _queries(spark, d), _corpus(spark, d))


def failure_causes(spark, d):
    return _failures(spark, d)


def cause_histogram(spark, d):
    return analysis.cause_histogram(_failures(spark, d))


def truncated_failures(spark, d):
    return analysis.truncated_failures(_failures(spark, d))


def truncated_relevant(spark, d):
    return analysis.truncated_relevant(_deltas(spark, d))


def timing_summary(spark, d):
    """Logged values taken as timings: each kind of event, and their total run by run."""
    run = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    timings = load(spark, d, "events").where("value IS NOT NULL AND event_type IS NOT NULL").select(F.col("event_type").alias("operation"), run.alias("run"), F.col("value").alias("ms"))
    return summarise(timings)


# --- files


def read_back_collection(spark, d):
    """A collection written as JSON lines and tab-separated judgments, read raw; its judged documents in the order of the lines."""
    folder = new_path(spark, "collection")
    _corpus(spark, d).select(F.col("doc_id").alias("_id"), "title", F.col("text_raw").alias("text")).orderBy("_id").write.json(f"{folder}/corpus")
    _queries(spark, d).select(F.col("query_id").alias("_id"), F.col("query_raw").alias("text")).write.json(f"{folder}/queries")
    _qrels(spark, d).select("query_id", "doc_id", "relevance").write.option("sep", "\t").option("header", True).csv(f"{folder}/qrels")
    corpus, asked, qrels = io.read_collection(spark, f"{folder}/corpus", f"{folder}/queries", f"{folder}/qrels")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("corpus_ord"))
    return qrels.join(corpus, "doc_id").join(asked, "query_id").select("query_id", "query_text", "doc_id", "title", "abstract", "relevance", place.alias("place"))


def read_back_prepared(spark, d):
    folder = new_path(spark, "prepared")
    io.write_prepared(folder, _corpus(spark, d).select("doc_id", "title", "text_raw", "n_tokens", "has_abbrev"), _queries(spark, d), _qrels(spark, d))
    corpus, asked, qrels = io.read_prepared(spark, folder)
    return qrels.join(corpus, "doc_id").join(asked, "query_id").select("query_id", "doc_id", "relevance", "title", F.col("n_tokens").cast("string").alias("n_tokens"), "query_norm")


def read_back_run(spark, d):
    """Two stages written to one table of runs, one of them twice; the other is read."""
    folder = new_path(spark, "runs")
    for stage in ("bm25", "dense", "dense"):
        io.write_run(_stage(spark, d, stage, POOL), stage, folder)
    return io.read_run(spark, "bm25", folder)


def read_back_table(spark, d):
    """A result table through CSV, with explicit types: ids stay strings."""
    path = new_path(spark, "table")
    rows = metrics.evaluate(_stage(spark, d, "dense"), _qrels(spark, d)).select("query_id", F.round("ndcg", 9).alias("ndcg"), F.round("mrr", 9).alias("mrr"))
    io.write_table(rows, path)
    return io.read_table(spark, path, rows.schema)


def latency_summary(spark, d):
    """Median, p95, mean, least and most of logged values by kind of event."""
    v = F.col("value")
    return load(spark, d, "events").groupBy("event_type").agg(
        F.round(F.percentile(v, 0.5), 6).alias("p50"), F.round(F.percentile(v, 0.95), 6).alias("p95"), F.round(F.avg(v), 6).alias("mean"),
        F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.count(v).alias("n_runs"),
    )


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            markup_stripped, clean_text, prepared_corpus, dedup_keep_first, token_stats, abbrev_flag, length_summary, prep_counters, queries_semi, prepared_queries, qrels_semi,
            queries_with_several_judgments, ambiguous_abbrevs, term_df_idf, bm25_scores, bm25_topk, dense_topk, rrf_hybrid_topk, hybrid_topk, hybrid_own_topk, packed_runs, unpacked_runs,
            rerank_overlap_topk, truncation_rate, pair_trace, model_trace, grid_k, grid_gap, metrics_per_query, metrics_mrr_cut, metrics_unjudged_too, metrics_aggregate, recall_ceiling, recall_ceiling_pivot,
            per_query_deltas, compare_runs, wilcoxon_stats, wilcoxon_p, bootstrap_hash_ci, bootstrap_replay_ci, rank_delta_table, ndcg_delta, case_selection, case_evidence,
            lexical_mismatch, semantic_drift, lexical_mismatch_top5, semantic_drift_top5, worst5, failure_causes, cause_histogram, truncated_failures, truncated_relevant, latency_summary, timing_summary,
            read_back_collection, read_back_prepared, read_back_run, read_back_table,
        )
    }


def oracle_sql() -> dict[str, str]:
    from rankmill.plans.oracle import SQL

    return SQL
