"""Lexical and dense search of the same texts, fused by reciprocal ranks."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.text import TOKEN
from rankmill.operators import bm25, dense
from rankmill.operators.runs import reciprocal_rank_fusion

DIMENSIONS = 64


def _hashed_terms(texts: list[str]) -> np.ndarray:
    find = re.compile(TOKEN).findall
    out = np.zeros((len(texts), DIMENSIONS))
    for i, t in enumerate(texts):
        for w in find(t.lower()):
            out[i, (len(w) * 31 + ord(w[0]) * 7 + ord(w[-1]) * 13) % DIMENSIONS] += 1
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def hashed_terms(text: Column) -> Column:
    """A deterministic stand-in for a model's encoder: counts of tokens by a hash of their length, first and last character, at unit length. A text without a token gives the zero vector."""
    return dense.encoder(_hashed_terms, 1024)(text)


def search(corpus: DataFrame, queries: DataFrame, index: bm25.Bm25, encode: Callable[[Column], Column] = hashed_terms, k: int = 20, pool: int = 100, rrf_k: int = 60, text: str = "text_norm", query: str = "query_raw") -> DataFrame:
    """query_id, doc_id, rrf and rank of the ``k`` best: both searches go ``pool`` deep, with the same query text, before they are fused.

    ``encode`` turns a text column into vectors, by ``dense.encoder`` or an expression; it is applied to both tables alike. Null texts are empty.
    """
    lexical = bm25.search(corpus, queries, index, pool, text, query)
    vectors = corpus.where("doc_id IS NOT NULL").select("doc_id", encode(F.col(text)).alias("v"))
    asked = queries.where("query_id IS NOT NULL").groupBy("query_id").agg(F.min(query).alias("q")).select("query_id", encode(F.col("q")).alias("v"))
    near = dense.search(vectors, asked, pool, "doc_id", "query_id", "v")
    return reciprocal_rank_fusion([lexical, near], rrf_k, k)
