"""Corpus preparation: cleaning, keep-first deduplication, semi-joins to judged queries, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmill.functions import text as X
from rankmill.operators.skew import HOT_SHARE, lookup
from rankmill.operators.storage import materialize, spread


def clean_corpus(raw: DataFrame, with_title: bool = True) -> DataFrame:
    """doc_id, title, text_raw, text_norm, corpus_ord and the dedup_key of raw (doc_id, title, abstract, corpus_ord).

    ``with_title=False``: the abstract column already begins with the title. Nulls are empty
    texts; title-only and empty records are kept.
    """
    title, abstract = X.blank_null(F.col("title")), X.blank_null(F.col("abstract"))
    both = F.trim(F.concat(title, F.lit(" "), abstract)) if with_title else abstract
    cleaned = raw.select(F.col("doc_id").cast("string").alias("doc_id"), X.clean_raw(title).alias("title"), X.clean_raw(both).alias("text_raw"), "corpus_ord")
    normal = cleaned.withColumn("text_norm", X.clean_norm(F.col("text_raw")))
    return normal.withColumn("dedup_key", X.dedup_key(F.col("title"), F.col("text_norm")))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of lowest ``order`` for each key; rows that tie in both all stay.

    Only (key, order) is shuffled to find the rows that are not the first of their key, a key with many rows by
    broadcast. The others are what doesn't meet them: copies are few, so the whole rows seldom have to move.
    """
    keys = materialize(df.select(key, order), "keys")
    total = keys.count()
    first = keys.groupBy(key).agg(F.min(order).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    later = lookup(keys, first, [key], F.col("__n") >= F.lit(HOT_SHARE * total)).where(F.col(order) > F.col("__first")).select(key, order)
    return df.join(later, [key, order], "left_anti").select(*df.columns)


def prepare_corpus(raw: DataFrame, with_title: bool = True) -> DataFrame:
    """The cleaned, deduplicated corpus with n_tokens and has_abbrev; ``corpus_ord`` must be unique.

    Cleaned texts are written once. They are shuffled only where the copies are too many to be broadcast.
    """
    cleaned = materialize(clean_corpus(spread(raw), with_title), "cleaned")
    return add_text_flags(keep_first(cleaned, "dedup_key", "corpus_ord")).drop("dedup_key")


def add_text_flags(df: DataFrame) -> DataFrame:
    return df.withColumn("n_tokens", X.white_tokens(F.col("text_raw"))).withColumn("has_abbrev", X.has_abbreviation(F.col("text_raw")))


def prepare_queries(raw: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with any judgment, positive or not, cleaned."""
    judged = raw.join(qrels.select("query_id").where("query_id IS NOT NULL").distinct(), "query_id", "left_semi")
    cleaned = judged.select(F.col("query_id").cast("string").alias("query_id"), X.clean_raw(F.col("query_text")).alias("query_raw"))
    return cleaned.withColumn("query_norm", X.clean_norm(F.col("query_raw"))).withColumn("has_abbrev", X.has_abbreviation(F.col("query_raw")))


def prepare_qrels(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judgments of documents that survived."""
    return qrels.join(corpus.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "relevance")


def one_judgment(qrels: DataFrame) -> DataFrame:
    """One relevance per (query, document): the highest, as the rows of a table have no order. Null grades are no judgments."""
    return qrels.where("query_id IS NOT NULL AND doc_id IS NOT NULL AND relevance IS NOT NULL").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))


def length_summary(corpus: DataFrame, over: int = 512) -> DataFrame:
    """One row: mean, median, p95 (interpolated), max and min of n_tokens, and the share over a limit in percent."""
    n = F.col("n_tokens")
    return corpus.agg(
        F.avg(n).alias("mean"), F.percentile(n, 0.5).alias("median"), F.percentile(n, 0.95).alias("p95"), F.max(n).alias("max"), F.min(n).alias("min"),
        (F.sum(F.when(n > over, 100.0).otherwise(0.0)) / F.count("*")).alias("pct_over"),
    )


def prep_counters(raw: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row of counters over raw (title, abstract) and the prepared corpus. Artefacts are counted per field and summed."""
    title, abstract = X.blank_null(F.col("title")), X.blank_null(F.col("abstract"))
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    before = raw.agg(
        F.count("*").alias("n_raw"), flag(F.trim(abstract) == "").alias("n_empty_abstract"), flag((F.trim(abstract) == "") & (F.trim(title) != "")).alias("n_title_only"),
        flag(X.has_html(title)).alias("n_html_title"), flag(X.has_html(abstract)).alias("n_html_abstract"),
        flag(X.has_latex(title)).alias("n_latex_title"), flag(X.has_latex(abstract)).alias("n_latex_abstract"),
    )
    after = corpus.agg(F.count("*").alias("n_kept"), flag(F.col("has_abbrev")).alias("n_abbrev"), (100.0 * flag(F.col("has_abbrev")) / F.count("*")).alias("pct_abbrev"))
    both = before.crossJoin(after)  # one row each
    return both.withColumn("n_removed", F.col("n_raw") - F.col("n_kept")).withColumn("n_html", F.col("n_html_title") + F.col("n_html_abstract")).withColumn("n_latex", F.col("n_latex_title") + F.col("n_latex_abstract"))


def queries_with_several_judgments(qrels: DataFrame) -> DataFrame:
    """Number of queries with more than one judgment row, whatever the grade."""
    return qrels.groupBy("query_id").count().where("count > 1").agg(F.count("*").alias("n_multi"))


def ambiguous_abbreviations(corpus: DataFrame, min_expansions: int = 2, min_occurrences: int = 3, max_occurrences: int = 40, top_n: int = 10) -> DataFrame:
    """Abbreviations of moderate frequency that stand beside several words, most words per occurrence first, then by name."""
    each = corpus.where(F.col("text_raw").rlike(X.ABBREVIATION)).select(F.explode(X.abbreviation_contexts(F.col("text_raw"))).alias("x")).select("x.*")
    by_word = each.groupBy("abbreviation", "word").agg(F.count("*").alias("n"))
    grouped = by_word.groupBy("abbreviation").agg(F.sum("n").alias("n_occurrences"), F.count("word").alias("n_distinct_nearby_words"))
    picked = grouped.where((F.col("n_distinct_nearby_words") >= min_expansions) & F.col("n_occurrences").between(min_occurrences, max_occurrences))
    top = picked.orderBy((F.col("n_distinct_nearby_words") / F.col("n_occurrences")).desc(), "abbreviation").limit(top_n)
    words = by_word.join(F.broadcast(top.select("abbreviation")), "abbreviation", "left_semi").where("word IS NOT NULL")
    sample = words.withColumn("i", F.row_number().over(Window.partitionBy("abbreviation").orderBy("word"))).where("i <= 8")
    return top.join(sample.groupBy("abbreviation").agg(F.array_sort(F.collect_list("word")).alias("sample_nearby_words")), "abbreviation")
