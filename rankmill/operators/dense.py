"""Dense retrieval: exact top-k by dot product, the corpus scanned in Arrow blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.operators.bm25 import SCORES_AT_ONCE, RunningTop
from rankmill.operators.runs import rank_rows
from rankmill.operators.storage import spread

#: Bytes of query vectors of one pass over the corpus, whatever their length.
QUERY_BYTES = 64 << 20


def l2_normalize(vector: Column) -> Column:
    """Unit length; the zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # As an array of one, vector and length are evaluated once and not for each component.
    once = F.array(F.struct(vector.alias("v"), norm.alias("n")))
    unit = F.transform(once, lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: (x / s["n"]).cast("float"))).otherwise(s["v"]))
    return F.element_at(unit, 1)


def encoder(encode: Callable[[list[str]], np.ndarray], batch: int = 64):
    """An Arrow function that turns texts into vectors with ``encode``, which is built or loaded in the worker."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            filled = texts.fillna("").tolist()
            yield pd.Series([list(map(float, v)) for i in range(0, len(filled), batch) for v in encode(filled[i : i + batch])])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", query_id: str = "query_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, doc_id, score and rank of the ``k`` vectors of highest dot product, ties to the smaller doc_id.

    Exact: every vector is scored, by block products in double precision; a task keeps the k best
    rows of each query so far and gives them at its end, and the window merges them. Queries go along in blocks of QUERY_BYTES. Null
    vectors and ids are left out; vectors must have one length.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = spread(docs).where(F.col(doc_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col(query_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    asked_kind = asked.schema["query_id"].dataType.simpleString()
    passes = 1 + (asked.agg(F.sum(8 * F.size("v"))).first()[0] or 0) // QUERY_BYTES
    sc, found = docs.sparkSession.sparkContext, None
    for p in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
        got = part.toArrow()
        matrix = np.array(got.column("v").to_pylist(), dtype=np.float64).reshape(got.num_rows, -1)
        sent = sc.broadcast((got.column("query_id").combine_chunks(), matrix))
        hits = rows.mapInArrow(_scorer(sent, k, digits), f"query_id {asked_kind}, doc_id {kind}, score double")
        found = hits if found is None else found.unionByName(hits)
    return rank_rows(found, [F.desc("score"), F.asc("doc_id")], k).select("query_id", "doc_id", "score", "rank")


def _scorer(sent, k: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        n = len(names)
        top, ids, seen, kind = RunningTop(n, k), [], 0, None
        for batch in batches:
            size = batch.num_rows
            if not size or not n:
                continue
            block = batch.column(1).flatten().to_numpy().reshape(size, -1)
            kind = batch.schema.field(0).type
            own = batch.column(0).to_pylist()
            ids.append(pa.array(own, kind))  # copied, so that the batch can go
            order = np.array([x.encode() for x in own] if isinstance(own[0], str) else own)
            row = np.arange(seen, seen + size)
            seen += size
            step = max(1, SCORES_AT_ONCE // size)
            for first in range(0, n, step):
                top.add(first, np.round(matrix[first : first + step] @ block.T, digits), order, row)
        if kind is not None:
            docs = pa.chunked_array(ids, kind)
            for query, score, _, row in top.batches():
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), docs.take(pa.array(row)).combine_chunks(), pa.array(score)], names=["query_id", "doc_id", "score"])

    return run
