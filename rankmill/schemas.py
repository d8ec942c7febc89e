"""Explicit schemas of the tables; readers never infer types."""

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _of(columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(","))])


CORPUS_RAW = _of("doc_id string, title string, abstract string, corpus_ord bigint")
CORPUS = _of("doc_id string, title string, text_raw string, text_norm string, n_tokens int, has_abbrev boolean")
QUERIES_RAW = _of("query_id string, query_text string")
QUERIES = _of("query_id string, query_raw string, query_norm string, has_abbrev boolean")
QRELS = _of("query_id string, doc_id string, relevance double")
RUN = _of("query_id string, doc_id string, rank int, stage string, score double")
RERANKED = _of("doc_id string, score double, n_tokens_before_truncation int, was_truncated boolean")
RANK_DELTAS = _of("query_id string, query string, doc_id string, doc_title string, rank_stage1 int, rank_ce int, delta int, is_relevant boolean, was_truncated boolean")
NDCG_DELTAS = _of("query_id string, ndcg_stage1 double, ndcg_ce double, ndcg_delta double")
CASES = _of("case string, query_id string, note string, query_raw string")
