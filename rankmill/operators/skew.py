"""Joins and ranks that hold when one key owns a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankmill.operators.storage import materialize

#: A key is hot if it owns at least this share of the rows; fewer than 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 0.001
#: Ways by which the rows of hot keys go through a shuffle.
SALTS = 4096


def lookup(left: DataFrame, dim: DataFrame, on: Sequence[str], hot: Column, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``dim``, which has one row per key, without sending a hot key to one task.

    ``hot`` is a condition on ``dim`` that few keys can meet, because each such key stands for
    a fixed share of the rows of ``left`` (see HOT_SHARE): that part of ``dim`` has a proven
    size bound and is broadcast. One shuffle join serves the rest; rows that are served already,
    and rows with a null key, go through it under a salt, evenly spread. ``left`` is read
    once. ``how`` is inner or left. Rows whose key is null match nothing.
    """
    flagged = dim.withColumn("__hot", F.coalesce(hot, F.lit(False)))
    values = [c for c in dim.columns if c not in on]
    own = F.struct(*values) if values else F.struct(F.lit(1).alias("__matched"))
    few = flagged.where("__hot").select(*on, own.alias("__few"))
    many = flagged.where("NOT __hot").select(*on, F.lit(0).cast("long").alias("__salt"), own.alias("__many"))
    tried = left.join(F.broadcast(few), list(on), "left")
    served = F.col("__few").isNotNull()
    for c in on:
        served = served | F.col(c).isNull()
    # Partition and content, not a random number: a task that runs again sends its rows the same way.
    salt = F.when(served, 1 + F.pmod(F.xxhash64(F.spark_partition_id(), *left.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("long")
    joined = tried.withColumn("__salt", salt).join(many, [*on, "__salt"], "left").withColumn("__found", F.coalesce("__few", "__many"))
    if how == "inner":
        joined = joined.where(F.col("__found").isNotNull())
    return joined.select(*on, *[c for c in left.columns if c not in on], *[F.col("__found")[v].alias(v) for v in values])


def rank_in_groups(df: DataFrame, groups: Sequence[str], score: str, rank: str = "rank", then: Sequence[str] = ()) -> DataFrame:
    """Competition rank (1 + rows with a higher score) of each row within its group, highest score first.

    Groups of any size: rows are range-partitioned by (group, score), so one group spreads over
    as many partitions as it needs. Each partition ranks its own rows; a table with at most one
    row per partition boundary carries the counts before it. Equal scores share a partition
    and so a rank; the columns of ``then`` part them, lowest first and null last. ``score`` must be
    free of null and NaN. Adds ``rank`` BIGINT; an empty
    table stays empty.
    """
    names = [*groups, score, *then]
    order = [*map(F.col, groups), F.col(score).desc(), *map(F.asc_nulls_last, then)]
    schema = T.StructType([*df.schema.fields, T.StructField("__pid", T.IntegerType()), T.StructField("__local", T.LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last: tuple | None = None
        place = at = 0  # rows of the current group so far; rank of the last row
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            first = tuple(c[0].as_py() for c in cols)
            new_group = np.zeros(n, dtype=bool)
            new_score = np.zeros(n, dtype=bool)
            for k, c in enumerate(cols):
                codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                (new_score if k >= len(groups) else new_group)[1:] |= codes[1:] != codes[:-1]
            new_group[0] = last is None or first[: len(groups)] != last[: len(groups)]
            new_score |= new_group
            new_score[0] = last is None or first != last
            index = np.arange(n, dtype=np.int64)
            began = np.maximum.accumulate(np.where(new_group, index, -1))
            offset = np.where(began < 0, index + place, index - began)
            at_change = np.where(new_score, offset + 1, 0)
            since = np.maximum.accumulate(np.where(new_score, index, -1))
            ranks = np.where(since < 0, at, at_change[np.maximum(since, 0)])
            place, at = int(offset[-1]) + 1, int(ranks[-1])
            last = tuple(c[n - 1].as_py() for c in cols)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, pid, np.int32)), pa.array(ranks)], names=[*batch.schema.names, "__pid", "__local"])

    by_range = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = materialize(by_range.mapInArrow(local, schema), "rank")
    counts = ranked.groupBy(*groups, "__pid").count()
    earlier = Window.partitionBy(*groups).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.sum("count").over(earlier)).where("__before > 0")
    cond = F.lit(True)
    b = F.broadcast(before.select(*[F.col(g).alias(f"__b{i}") for i, g in enumerate(groups)], F.col("__pid").alias("__bpid"), "__before"))
    for i, g in enumerate(groups):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__b{i}"))
    joined = ranked.join(b, (F.col("__pid") == F.col("__bpid")) & cond, "left")
    return joined.select(*df.columns, (F.col("__local") + F.coalesce("__before", F.lit(0))).alias(rank))


def running_total(df: DataFrame, order: str, value: str, total: str = "before") -> DataFrame:
    """Adds the sum of ``value`` (BIGINT) over the rows of lower ``order``, whose values must be distinct and not null.

    Rows are range-partitioned, so none of them all are in one place; a partition adds up its own, and a row for each
    partition carries what comes before it.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__pid", T.IntegerType()), T.StructField("__local", T.LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = so_far + np.cumsum(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), pid, np.int32)), pa.array(sums - own)], names=[*batch.schema.names, "__pid", "__local"])
            so_far = int(sums[-1]) if len(sums) else so_far

    summed = materialize(df.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(local, schema), "totals")
    earlier = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = summed.groupBy("__pid").agg(F.sum(value).alias("s")).withColumn("__before", F.coalesce(F.sum("s").over(earlier), F.lit(0))).select("__pid", "__before")
    return summed.join(F.broadcast(parts), "__pid").select(*df.columns, (F.col("__local") + F.col("__before")).alias(total))
