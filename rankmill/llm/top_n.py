"""Problem 1: the N best items of every group, by statistics-guided skipping.

The rows are laid out once in files clustered by group. In a file, a group's rows are spread over
bands of falling score: its first rows, then as many again, then twice as many, and so on. Each
row group holds one band of one or several groups, and the footer has statistics of every
group in it: its highest score and its number of rows there. A scan opens each file's
footer, reads row groups from the highest band down and, within a band, in falling order of
their highest score, and skips those that lie below the N-th score that every group in
them already has. A group of any size spreads over several files, each of which gives at most N
rows of it.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankmill.operators.storage import materialize, new_path

#: Rows of a group in its first band.
FIRST_BAND = 16
#: Rows of a row group, more or less: it ends at the end of a group, if that has less than so many rows in the band.
ROW_GROUP = 4096
STATISTICS = b"group_statistics"


def _orders(ties: Sequence[str]) -> list[Column]:
    return [F.col("__score").desc(), *[F.col(f"__t{i}").asc_nulls_last() for i in range(len(ties))], F.col("__item").asc()]


def cluster_by_group(df: DataFrame, groups: Sequence[str], item: str, score: str, ties: Sequence[str], path: str, row_group: int = ROW_GROUP, first_band: int = FIRST_BAND) -> DataFrame:
    """Write the rows that count below ``path``, clustered by group and in bands of falling score; the files (uri, n_rows, n_row_groups).

    Rows with a null group column, null item, or null or NaN score don't count. The range
    partitioning includes the score, so that a hot group is cut into several files of falling score.
    A task that runs again writes a file of another name; only files of tasks that ended well are listed.
    """
    score_type = df.schema[score].dataType
    rows = df.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        F.when(F.col(score) == 0, F.lit(0).cast(score_type)).otherwise(F.col(score)).alias("__score"),  # -0.0 is 0.0
        *[F.col(t).alias(f"__t{i}") for i, t in enumerate(ties)],
        F.col(item).alias("__item"),
    )
    keep = F.col("__score").isNotNull() & ~F.isnan(F.col("__score").cast("double")) & F.col("__item").isNotNull()
    for i in range(len(groups)):
        keep = keep & F.col(f"__g{i}").isNotNull()
    order = [*[F.col(f"__g{i}") for i in range(len(groups))], *_orders(ties)]
    n_groups = len(groups)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{path}/part-{TaskContext.get().partitionId():05}-{uuid.uuid4().hex}.parquet"
        n_rows, n_row_groups = write_clustered(batches, uri, n_groups, row_group, first_band)
        if n_rows:
            yield pa.RecordBatch.from_pydict({"uri": [uri], "n_rows": pa.array([n_rows], pa.int64()), "n_row_groups": pa.array([n_row_groups], pa.int32())})

    by_range = rows.where(keep).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(by_range.mapInArrow(write, "uri string, n_rows long, n_row_groups int"), "files")


def _begins(columns: Sequence[pa.Array]) -> np.ndarray:
    """Whether each row differs from the one before in any of the columns; the first does."""
    new = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        codes = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[:1] = True
    return new


class _Bands:
    """Takes the rows of a file in order and writes row groups; holds about a row group and a batch of each band."""

    def __init__(self, uri: str, schema: pa.Schema, n_groups: int, row_group: int, first_band: int) -> None:
        filesystem, where = pafs.FileSystem.from_uri(uri)
        filesystem.create_dir(where.rsplit("/", 1)[0], recursive=True)
        self.writer = pq.ParquetWriter(where, schema, filesystem=filesystem, compression="zstd")
        self.n_groups, self.row_group, self.first_band = n_groups, row_group, first_band
        self.held: dict[int, list[pa.RecordBatch]] = {}
        self.statistics: list[pa.Table] = []
        self.last: tuple | None = None  # the group of the last row, and how many rows of it there were
        self.place = self.n_rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        keys = [batch.column(i) for i in range(self.n_groups)]
        new = _begins(keys)
        first, last = (tuple(k[i].as_py() for k in keys) for i in (0, -1))
        index = np.arange(len(new))
        place = index - np.maximum.accumulate(np.where(new, index, 0))
        if first == self.last:
            place[: np.argmax(new[1:]) + 1 if new[1:].any() else None] += self.place
        self.last, self.place, self.n_rows = last, int(place[-1]) + 1, self.n_rows + len(new)
        band = np.where(place < self.first_band, 0, np.floor(np.log2(np.maximum(place, 1) / self.first_band)).astype(np.int64) + 1)
        for b in np.unique(band).tolist():
            self.held.setdefault(b, []).append(batch.take(pa.array(np.flatnonzero(band == b))))
            if sum(x.num_rows for x in self.held[b]) >= 2 * self.row_group:
                self._flush(b, self.row_group)

    def _flush(self, band: int, leave: int) -> None:
        rows = pa.Table.from_batches(self.held[band]).combine_chunks()
        starts = np.flatnonzero(_begins([rows.column(i).combine_chunks() for i in range(self.n_groups)]))
        at = 0
        while rows.num_rows - at > leave:
            end = min(at + self.row_group, rows.num_rows)
            if end < rows.num_rows:
                border = starts[np.searchsorted(starts, end, side="right") - 1]
                end = int(border) if border > at else end
            own = np.concatenate([[at], starts[(starts > at) & (starts < end)]])
            some = rows.slice(at, end - at)
            self.writer.write_table(some, row_group_size=end - at)
            heads = rows.take(pa.array(own)).select(list(range(self.n_groups + 1)))
            counts = pa.array(np.diff(np.append(own, end)), pa.int64())
            for name, values in (("__rows", counts), ("__band", pa.array([band] * len(own), pa.int32())), ("__row_group", pa.array([len(self.statistics)] * len(own), pa.int32()))):
                heads = heads.append_column(name, values)
            self.statistics.append(heads)
            at = end
        self.held[band] = rows.slice(at).to_batches()

    def close(self) -> None:
        for band in sorted(self.held):
            self._flush(band, 0)
        sink = pa.BufferOutputStream()
        table = pa.concat_tables(self.statistics)
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.writer.add_key_value_metadata({STATISTICS: base64.b64encode(sink.getvalue().to_pybytes())})
        self.writer.close()


def write_clustered(batches: Iterator[pa.RecordBatch], uri: str, n_groups: int, row_group: int = ROW_GROUP, first_band: int = FIRST_BAND) -> tuple[int, int]:
    """Write rows that come in order of group and falling score to one file; its rows and row groups. Without rows there is no file."""
    bands = None
    for batch in batches:
        if batch.num_rows:
            bands = bands or _Bands(uri, batch.schema, n_groups, row_group, first_band)
            bands.add(batch)
    if bands is None:
        return 0, 0
    bands.close()
    return bands.n_rows, len(bands.statistics)


def scan_top_n(uri: str, n_groups: int, n_ties: int, n: int) -> tuple[pa.Table, int, int]:
    """The first ``n`` items of each group in one clustered file; how many row groups were read, how many skipped."""
    filesystem, path = pafs.FileSystem.from_uri(uri)
    columns = ["__score", *[f"__t{i}" for i in range(n_ties)], "__item"]
    with filesystem.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        statistics = pa.ipc.open_stream(base64.b64decode(file.metadata.metadata[STATISTICS])).read_all()
        keys = statistics.select(list(range(n_groups)))
        # Equal groups of different row groups get one code; ``named`` has a row of each.
        code = keys.to_pandas().groupby(list(keys.column_names), sort=False, dropna=False).ngroup().to_numpy()
        _, named = np.unique(code, return_index=True)
        top, count = statistics.column("__score").to_pandas().to_numpy(), statistics.column("__rows").to_numpy()
        row_group, band = statistics.column("__row_group").to_numpy(), statistics.column("__band").to_numpy()
        begin = np.searchsorted(row_group, np.arange(file.metadata.num_row_groups + 1))
        have, nth, to_come = np.zeros(len(named), dtype=np.int64), np.empty(len(named), dtype=top.dtype), np.bincount(code)
        met: dict[int, set] = {}  # items of the groups that are neither full nor over
        found, of, read = [], [], 0
        for k in sorted(range(len(begin) - 1), key=lambda k: (band[begin[k]], -max(top[begin[k] : begin[k + 1]]))):
            s = slice(begin[k], begin[k + 1])
            own = code[s]
            to_come[own] -= 1
            # Rows of a lower band come after those of a higher one in every tie too, so an equal score can't come first.
            done = have[own] >= n
            done[done] = top[s][done] <= nth[own[done]]
            if done.all():
                continue
            read += 1
            rows = file.read_row_group(k, columns=columns)
            group = np.repeat(own, count[s])
            at = np.flatnonzero(~np.repeat(done, count[s]))
            item = rows.column("__item").combine_chunks().dictionary_encode()
            at = at[~pd.DataFrame({"g": group[at], "i": item.indices.to_numpy()[at]}).duplicated().to_numpy()]  # rows are in order: an item's first is its best
            if met and (again := [g for g in own.tolist() if g in met]):
                names = rows.column("__item").combine_chunks()
                some = np.isin(group[at], again)
                at = at[~np.array([s and names[int(i)].as_py() in met[int(group[i])] for s, i in zip(some, at)], dtype=bool)]
            own_group = group[at]
            starts = np.flatnonzero(np.concatenate([[True], own_group[1:] != own_group[:-1]])) if len(at) else np.zeros(0, dtype=np.int64)
            size = np.diff(np.append(starts, len(at)))
            place = np.arange(len(at)) - np.repeat(starts, size) + have[own_group]
            at, own_group = at[place < n], own_group[place < n]
            taken = rows.take(pa.array(at))
            np.add.at(have, own_group, 1)
            nth[own_group] = taken.column("__score").to_pandas().to_numpy()  # the last of a group stays
            for g in own[~done].tolist():
                if have[g] < n and to_come[g]:
                    mine = taken.column("__item").take(pa.array(np.flatnonzero(own_group == g)))
                    met.setdefault(g, set()).update(mine.to_pylist())
                else:
                    met.pop(g, None)
            found.append(taken)
            of.append(own_group)
        groups = keys.take(pa.array(named[np.concatenate(of)]))
        rest = pa.concat_tables(found)
        return pa.table([*groups.columns, *rest.columns], names=[*groups.column_names, *rest.column_names]), read, len(begin) - 1 - read


def top_n_of_clustered(files: DataFrame, kinds: T.StructType, groups: Sequence[str], item: str, score: str, ties: Sequence[str], n: int, place: str = "place") -> DataFrame:
    """The first ``n`` items of every group of the ``files`` that ``cluster_by_group`` listed; ``kinds`` is the schema of the table they hold.

    A task scans some of the files; one shuffle by group merges the files of a group that
    spans several, at most ``n`` rows of it per file.
    """
    n_groups, n_ties = len(groups), len(ties)
    keys = [f"__g{i}" for i in range(n_groups)]
    fields = [*keys, "__score", *[f"__t{i}" for i in range(n_ties)], "__item"]
    types = [kinds[c].dataType for c in (*groups, score, *ties, item)]
    arrow = pa.schema([(f, _arrow_type(t)) for f, t in zip(fields, types)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                yield from scan_top_n(uri, n_groups, n_ties, n)[0].cast(arrow).combine_chunks().to_batches()

    each = files.select("uri").repartition(max(1, files.count()))  # names of files, to as many tasks
    found = each.mapInArrow(scan, T.StructType([T.StructField(f, t) for f, t in zip(fields, types)])).repartition(*keys)  # both windows keep to this
    order = _orders(ties)
    once = found.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__item").orderBy(*order))).where("__n = 1")
    placed = once.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n)
    return placed.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], F.col("__n").alias(place), F.col("__item").alias(item), F.col("__score").alias(score), *[F.col(f"__t{i}").alias(t) for i, t in enumerate(ties)])


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.timestamp("us", "UTC") if isinstance(kind, T.TimestampType) else to_arrow_type(kind)


def top_n_per_group(df: DataFrame, groups: Sequence[str], item: str, score: str, ties: Sequence[str] = (), n: int = 10, place: str = "place") -> DataFrame:
    """The ``n`` best distinct items of every group: higher score, then smaller ``ties`` (nulls last), then smaller item.

    Rows with a null group, a null item, or a null or NaN score don't count; an item stands
    once, at its first row; repeated rows change nothing; groups with fewer than ``n`` items
    give what they have; an empty table gives no rows. Other columns, whatever their names, are left alone.
    """
    files = cluster_by_group(df, groups, item, score, ties, new_path(df.sparkSession, "clustered"))
    return top_n_of_clustered(files, df.schema, groups, item, score, ties, n, place)
