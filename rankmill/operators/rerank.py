"""Second stage: a candidate pool joined to its texts, scored by a pluggable pair scorer, sorted again."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.text import content_words, tokens
from rankmill.operators.metrics import aggregate, evaluate
from rankmill.operators.runs import rank_rows
from rankmill.operators.storage import materialize, spread
from rankmill.utils.runtime import Timings, run_fully, summarise


class PairScorer(Protocol):
    """Columns for (query, text) pairs, from features that are computed once per query and once per text, before they are paired."""

    name: str
    max_length: int

    def features(self, text: Column) -> Column: ...

    def score(self, query: Column, text: Column) -> Column: ...

    def n_tokens(self, query: Column, text: Column) -> Column:
        """Length of the pair before truncation."""


class OverlapScorer:
    """Deterministic stand-in for a model, in the JVM: the share of the query's content words that the text has, plus a small bonus for short texts."""

    name = "overlap"

    def __init__(self, max_length: int = 512, bonus: float = 0.1) -> None:
        self.max_length, self.bonus = max_length, bonus

    def features(self, text: Column) -> Column:
        return F.struct(content_words(text).alias("words"), F.size(tokens(text)).alias("n"))

    def score(self, query: Column, text: Column) -> Column:
        share = F.size(F.array_intersect(query["words"], text["words"])) / F.greatest(F.size(query["words"]), F.lit(1))
        return share + self.bonus / (1.0 + text["n"])

    def n_tokens(self, query: Column, text: Column) -> Column:
        """Both texts' tokens and three special ones."""
        return query["n"] + text["n"] + 3


class DensityScorer(OverlapScorer):
    """A second stand-in: the share of the text's content words that the query has."""

    name = "density"

    def score(self, query: Column, text: Column) -> Column:
        return F.size(F.array_intersect(query["words"], text["words"])) / F.greatest(F.size(text["words"]), F.lit(1))


class ModelScorer:
    """A model behind an Arrow iterator function: ``load`` runs once per worker and returns pairs -> (logits, token counts).

    Pairs of a batch are scored in order of length, ``batch`` at a time, so that padding stays small.
    """

    def __init__(self, name: str, load: Callable[[], Callable[[list[tuple[str, str]]], tuple[Sequence[float], Sequence[int]]]], max_length: int = 512, batch: int = 16) -> None:
        self.name, self.load, self.max_length, self.batch = name, load, max_length, batch
        self._udf = self._build()

    def _build(self):
        load, batch = self.load, self.batch

        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            model = load()
            for query, text in parts:
                pairs = list(zip(query.fillna(""), text.fillna("")))
                order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]) + len(pairs[i][1]))
                out: list = [None] * len(pairs)
                for at in range(0, len(order), batch):
                    some = order[at : at + batch]
                    for i, s, n in zip(some, *model([pairs[i] for i in some])):
                        out[i] = (float(s), int(n))
                yield pd.DataFrame(out, columns=["score", "n"])

        run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run, "score double, n int")

    def features(self, text: Column) -> Column:
        return F.coalesce(text, F.lit(""))

    def score(self, query: Column, text: Column) -> Column:
        return self._udf(query, text)["score"]

    def n_tokens(self, query: Column, text: Column) -> Column:
        return self._udf(query, text)["n"]


def resolve_scorer(primary: Callable[[], PairScorer], fallback: Callable[[], PairScorer]) -> PairScorer:
    """The primary scorer, or the fallback if building it fails for any reason."""
    try:
        return primary()
    except Exception:  # noqa: BLE001
        return fallback()


def score_pool(pool: DataFrame, queries: DataFrame, corpus: DataFrame, scorer: PairScorer, k: int = 20, digits: int = 9) -> DataFrame:
    """query_id, doc_id, stage1_rank, score, n_tokens_before_truncation and was_truncated of the pool's first ``k``.

    Candidates that the corpus lacks are dropped.
    """
    pairs = pool.where(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("stage1_rank"))
    q = spread(queries.select("query_id", F.col("query_raw").alias("q"))).select("query_id", scorer.features(F.col("q")).alias("q"))
    t = spread(corpus.select("doc_id", F.col("text_raw").alias("t"))).select("doc_id", scorer.features(F.col("t")).alias("t"))
    scored = pairs.join(q, "query_id").join(t, "doc_id").select("query_id", "doc_id", "stage1_rank", F.round(scorer.score(F.col("q"), F.col("t")), digits).alias("score"), scorer.n_tokens(F.col("q"), F.col("t")).alias("n_tokens_before_truncation"))
    return scored.withColumn("was_truncated", F.col("n_tokens_before_truncation") > scorer.max_length)


def rerank_scored(scored: DataFrame, k: int, top_k: int | None = None) -> DataFrame:
    """The scored pool's first ``k`` sorted by score; equal scores keep the first stage's order."""
    return rank_rows(scored.where(F.col("stage1_rank") <= k), [F.desc("score"), F.asc("stage1_rank")], top_k or k)


def rerank(pool: DataFrame, queries: DataFrame, corpus: DataFrame, scorer: PairScorer, k: int = 20, top_k: int | None = None) -> DataFrame:
    return rerank_scored(score_pool(pool, queries, corpus, scorer, k), k, top_k)


def truncation_rate(scored: DataFrame) -> DataFrame:
    """One row: percent of pairs that were truncated, 0 without pairs."""
    return scored.agg(F.coalesce(F.avg(F.when(F.col("was_truncated"), 100.0).otherwise(0.0)), F.lit(0.0)).alias("truncation_pct"), F.count("*").alias("n_pairs"))


def pair_trace(pool: DataFrame, queries: DataFrame, corpus: DataFrame, scorer: PairScorer) -> DataFrame:
    """The worked trace of the first candidate of each query: query, tokens as they go in, length before truncation, logit."""
    top = score_pool(pool, queries, corpus, scorer, 1).drop("stage1_rank")
    texts = top.join(queries.select("query_id", F.col("query_raw").alias("query")), "query_id").join(corpus.select("doc_id", "text_raw"), "doc_id")
    marked = F.concat(F.array(F.lit("[CLS]")), tokens(F.col("query")), F.array(F.lit("[SEP]")), tokens(F.col("text_raw")))
    cut = F.concat(F.slice(marked, 1, scorer.max_length - 1), F.array(F.lit("[SEP]")))
    return texts.withColumn("tokens", cut).select("query_id", "query", "doc_id", "tokens", "n_tokens_before_truncation", "was_truncated", F.col("score").alias("logit"))


def encoded_pairs(query: Column, text: Column, vocabulary: str, max_length: int = 512) -> Column:
    """(input_ids, tokens, n_tokens_before_truncation) of pairs by a public tokenizer's file: start, query, end, text, end.

    The longer of the two gives up tokens at its end until the pair fits; null texts are empty. The file's first and
    last special tokens mark start and end.
    """

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        special = sorted(i for i, x in t.get_added_tokens_decoder().items() if x.special)
        start, end = special[0], special[-1]
        names = {i: x.content for i, x in t.get_added_tokens_decoder().items()}
        for pair in parts:
            a, b = (t.encode_batch(x.fillna("").tolist(), add_special_tokens=False) for x in pair)
            rows = []
            for q, d in zip(a, b):
                keep_q, keep_d = _longest_first(len(q.ids), len(d.ids), max_length - 3)
                rows.append(([start, *q.ids[:keep_q], end, *d.ids[:keep_d], end], [names[start], *q.tokens[:keep_q], names[end], *d.tokens[:keep_d], names[end]], len(q.ids) + len(d.ids) + 3))
            yield pd.DataFrame(rows, columns=["input_ids", "tokens", "n_tokens_before_truncation"])

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "input_ids array<int>, tokens array<string>, n_tokens_before_truncation int")(query, text)


def _longest_first(a: int, b: int, room: int) -> tuple[int, int]:
    """How much of two lengths stays if the longer gives way, one by one, until both fit; the second where they are equal."""
    if a + b <= room:
        return a, b
    half = room // 2
    if a <= room - half:
        return a, room - a
    if b <= half:
        return room - b, b
    return room - half, half


def model_trace(pool: DataFrame, queries: DataFrame, corpus: DataFrame, scorer: PairScorer, vocabulary: str) -> DataFrame:
    """``pair_trace`` by the ids of a public tokenizer: query_id, query, doc_id, input_ids, tokens, n_tokens_before_truncation, was_truncated and logit."""
    top = score_pool(pool, queries, corpus, scorer, 1).select("query_id", "doc_id", F.col("score").alias("logit"))
    texts = top.join(queries.select("query_id", F.col("query_raw").alias("query")), "query_id").join(corpus.select("doc_id", "text_raw"), "doc_id")
    traced = spread(texts).withColumn("x", encoded_pairs(F.col("query"), F.col("text_raw"), vocabulary, scorer.max_length))
    return traced.select("query_id", "query", "doc_id", "x.*", (F.col("x.n_tokens_before_truncation") > scorer.max_length).alias("was_truncated"), "logit")


def grid(scored: dict[str, DataFrame], qrels: DataFrame, run_queries: DataFrame, ks: Sequence[int] = (5, 10, 20, 50), cutoff: int = 5, names: dict[str, str] | None = None) -> DataFrame:
    """model, model_name, k, ndcg, mrr and n_queries of each model and pool size. Each model's pool is scored once, at its largest; smaller pools are its prefixes."""
    out = None
    for model, s in scored.items():
        for k in ks:
            found = aggregate(evaluate(rerank_scored(s, k), qrels, min(cutoff, k), run_queries))
            row = found.select(F.lit(model).alias("model"), F.lit((names or {}).get(model, model)).alias("model_name"), F.lit(k).alias("k"), "ndcg", "mrr", "n_queries")
            out = row if out is None else out.unionByName(row)
    return out


def timed_grid(scorers: dict[str, PairScorer], pool: DataFrame, queries: DataFrame, corpus: DataFrame, qrels: DataFrame, ks: Sequence[int] = (5, 10, 20, 50), cutoff: int = 5, warmup: int = 3, repeats: int = 5) -> DataFrame:
    """The grid with latency_p50_ms and latency_p95_ms: reranking the pool of the first query (by id) at each size, after warm-up."""
    spark = pool.sparkSession
    scored = {m: materialize(score_pool(pool, queries, corpus, s, max(ks)), "scored") for m, s in scorers.items()}
    quality = grid(scored, qrels, pool.select("query_id").distinct(), ks, cutoff, {m: s.name for m, s in scorers.items()})
    first = pool.agg(F.min("query_id")).first()[0]
    own = materialize(pool.where(F.col("query_id") == first), "pool")
    texts = materialize(corpus.join(own.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")
    asked = queries.where(F.col("query_id") == first)
    timings = Timings()
    for m, s in scorers.items():
        for k in ks:
            timings.repeat(f"{m}\t{k}", lambda s=s, k=k: run_fully(rerank(own, asked, texts, s, k)), warmup, repeats)
    parts = F.split("operation", "\t")
    latency = summarise(timings.table(spark)).where("operation <> 'total'").select(parts[0].alias("model"), parts[1].cast("int").alias("k"), F.col("p50_ms").alias("latency_p50_ms"), F.col("p95_ms").alias("latency_p95_ms"))
    return quality.join(F.broadcast(latency), ["model", "k"])  # a row for each model and size
