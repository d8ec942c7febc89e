"""Reading and writing: collections on disk, prepared tables, runs, result tables, JSON."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankmill import schemas


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_collection(spark: SparkSession, corpus_jsonl: str, queries_jsonl: str, qrels_tsv: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A retrieval collection as JSON lines (_id, title, text) and tab-separated judgments with a header.

    Ids become strings in all three tables, so that joins don't lose rows to types. ``corpus_ord`` (see ``in_file_order``)
    follows the names of the files and the order of their lines, however the files are split.
    """
    corpus = in_file_order(spark.read.schema(_strings("_id", "title", "text")).json(corpus_jsonl), "corpus_ord").withColumnsRenamed({"_id": "doc_id", "text": "abstract"})
    queries = spark.read.schema(_strings("_id", "text")).json(queries_jsonl).withColumnsRenamed({"_id": "query_id", "text": "query_text"})
    qrels = spark.read.schema(_strings("query_id", "doc_id", "relevance")).option("sep", "\t").option("header", True).csv(qrels_tsv)
    return corpus, queries, qrels.withColumn("relevance", F.col("relevance").cast("double"))


#: Rows that a part of a file can have, as their numbers take the lower bits of the order.
PART_ROWS = 1 << 33


def in_file_order(scan: DataFrame, order: str) -> DataFrame:
    """A scan of files with a column that numbers its rows in the order of file name, part of the file and row; unique, with gaps.

    Splits are packed into tasks by size, so a task's number says nothing about where its rows stand. The starts of the
    parts, one for each split, are numbered by name and place and broadcast; in a part, rows come in order.
    """
    parts = scan.select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start")).distinct()
    by_place = Window.orderBy("__path", "__start")
    numbered = parts.withColumn("__part", F.row_number().over(by_place) - 1)
    # The number that increases through a task does so in each of its parts too.
    rows = scan.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().bitwiseAND(F.lit(PART_ROWS - 1)).alias("__row"))
    return rows.join(F.broadcast(numbered), ["__path", "__start"]).withColumn(order, F.col("__part") * F.lit(PART_ROWS) + F.col("__row")).drop("__path", "__start", "__part", "__row")


def write_prepared(folder: str, corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> None:
    for name, df in (("corpus", corpus), ("queries", queries), ("qrels", qrels)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def read_prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder}/{name}.parquet") for name in ("corpus", "queries", "qrels"))


def write_run(run: DataFrame, stage: str, folder: str) -> None:
    """Runs live in one table partitioned by stage; writing one stage leaves the others."""
    run.select("query_id", "doc_id", "rank", "score").write.mode("overwrite").parquet(f"{folder}/stage={stage}")


def read_run(spark: SparkSession, stage: str, folder: str) -> DataFrame:
    """One stage's run; the partition is pruned before files are opened."""
    return spark.read.schema(schemas.RUN).parquet(folder).where(F.col("stage") == stage).select("query_id", "doc_id", "rank", "score")


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A small result table as one file with a header."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table by explicit schema: ids stay strings."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_object(df: DataFrame, path: str) -> None:
    """The one row of ``df`` as an indented JSON object."""
    row = df.select(F.to_json(F.struct(*df.columns)).alias("j")).first()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json.loads(row.j) if row else {}, f, indent=2)


def append_manifest(path: str, entry: dict) -> None:
    """One JSON line per run; earlier lines are never rewritten."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, sort_keys=True) + "\n")


def read_manifest(path: str) -> list[dict]:
    """The runs so far; lines that can't be read are passed over."""
    out = []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                try:
                    out.append(json.loads(line))
                except ValueError:
                    continue
    return out


def table_text(df: DataFrame, most: int = 100) -> str:
    """A small result table as aligned text, for a terminal; numbers stand to the right, doubles have four decimals. Raises beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a printed table takes {most} rows at most")
    number = [kind not in ("string", "boolean") and not kind.startswith(("array", "struct", "map")) for _, kind in df.dtypes]
    cells = [df.columns, *[["-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]]
    width = [max(len(c[i]) for c in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.rjust(w) if right else c.ljust(w) for c, w, right in zip(line, width, number)).rstrip() for line in cells)


#: More points than this aren't drawn, and none is left out: ``plot_lines`` raises.
CHART_POINTS = 10_000


def plot_lines(df: DataFrame, x: str, y: str, series: str, path: str) -> bool:
    """A line chart of a small table, one line per series; False where matplotlib isn't installed."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return False
    rows = df.select(x, y, series).orderBy(x).limit(CHART_POINTS + 1).collect()
    if len(rows) > CHART_POINTS:
        raise ValueError(f"a chart takes {CHART_POINTS} points at most; aggregate the table first")
    figure, axis = pyplot.subplots()
    for name in sorted({r[2] for r in rows}):
        axis.plot([r[0] for r in rows if r[2] == name], [r[1] for r in rows if r[2] == name], marker="o", label=name)
    axis.set_xlabel(x)
    axis.set_ylabel(y)
    axis.legend()
    figure.savefig(path)
    return True
