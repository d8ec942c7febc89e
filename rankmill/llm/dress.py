"""Problem 6: records that differ only in formatting, collapsed by dictionary-encoded columns.

Each column's values are brought to a canonical form and exchanged for integer identifiers by
a dictionary of the distinct canonical values; a record becomes a sorted tuple of (field,
identifier) integers, and these compact tuples are grouped. Stored values that many rows share are brought to
canonical form once. Dictionaries are keyed by 128 bits of the value's SHA-256, so whole texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.operators.skew import HOT_SHARE, lookup
from rankmill.operators.storage import materialize


def letters_and_digits(text: Column) -> Column:
    """The characters of Unicode categories L and N, lower case; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def title_and_rest(title: Column, text: Column) -> tuple[Column, Column]:
    """Canonical title, and canonical text without the title at its beginning or, failing that, its end."""
    t, x = letters_and_digits(title), letters_and_digits(text)
    rest = F.when(x.startswith(t), F.substring(x, F.length(t) + 1, F.length(x))).when(x.endswith(t), F.substring(x, F.lit(1), F.length(x) - F.length(t))).otherwise(x)
    return t, rest


def value_key(canonical: Column) -> Column:
    """128 bits of SHA-256, as a dictionary's key."""
    return F.unhex(F.substring(F.sha2(canonical, 256), 1, 32))


def dictionary(values: DataFrame, key: str) -> DataFrame:
    """(key, id, n) of the distinct keys: an integer identifier and the number of rows. Written once, so that identifiers hold under retries."""
    distinct = values.groupBy(key).agg(F.count("*").alias("n"))
    return materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "dictionary")


def encode(records: DataFrame, item: str, fields: Sequence[str]) -> DataFrame:
    """(item, fields_ids): each record as the sorted integer pairs (field number, value identifier).

    ``fields`` hold the values' keys, not null. Values that own a thousandth of the rows, such
    as the empty title, are looked up in a broadcast of at most a thousand of them.
    """
    total = records.count()
    rows = records.select(item, *fields)
    for i, f in enumerate(fields):
        ids = dictionary(records, f).select(F.col(f), F.col("id").alias(f"__id{i}"), F.col("n").alias(f"__n{i}"))
        rows = lookup(rows, ids, [f], F.col(f"__n{i}") >= F.lit(HOT_SHARE * total)).drop(f"__n{i}", f)
    pairs = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"__id{i}").alias("id")) for i in range(len(fields))])
    return rows.select(item, F.array_sort(pairs).alias("fields_ids"))


def collapse(encoded: DataFrame, item: str) -> DataFrame:
    """(fields_ids, kept, copies): the smallest item of each group of equal tuples and the number of its rows, pre-aggregated before the shuffle."""
    return encoded.groupBy("fields_ids").agg(F.min(item).alias("kept"), F.count("*").alias("copies"))


def canonical_records(df: DataFrame, item: str, title: str, text: str) -> DataFrame:
    """(item, f0, f1): the keys of each record's canonical title and rest; written once.

    The two columns depend on each other (``title_and_rest``), so what is canonicalised is the pair. Of a pair that a
    thousandth of the rows store, only the first row (smallest item) is; the others are taken out before that by a broadcast of
    these few pairs, and get its result by another. A rarer pair is canonicalised row by row, as texts would have to be
    shuffled to find its first.
    """
    stored = F.concat(F.when(F.col(title).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.length(title).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(title), F.lit("")), F.col(text))
    rows = df.where(F.col(item).isNotNull() & F.col(text).rlike(r"[\p{L}\p{N}]")).select(F.col(item).alias("item"), F.col(title).alias("t"), F.col(text).alias("x"), value_key(stored).alias("stored"))
    keys = materialize(rows.select("item", "stored"), "stored")
    least = F.lit(HOT_SHARE * keys.count())
    often = materialize(keys.groupBy("stored").agg(F.min("item").alias("first"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n"), "often")  # fewer than 1 / HOT_SHARE
    t, rest = title_and_rest(F.col("t"), F.col("x"))
    once = rows.join(F.broadcast(often), "stored", "left").where("first IS NULL OR item = first")
    known = materialize(once.select("item", value_key(t).alias("f0"), value_key(rest).alias("f1"), F.when(F.col("first").isNotNull(), F.col("stored")).alias("often")), "known")
    shared = known.where("often IS NOT NULL").select(F.col("often").alias("stored"), "f0", "f1").distinct()
    others = keys.join(F.broadcast(often), "stored").where("item <> first").join(F.broadcast(shared), "stored")
    return materialize(known.select("item", "f0", "f1").unionByName(others.select("item", "f0", "f1")).distinct(), "records")


def copies_of_records(df: DataFrame, item: str, title: str, text: str) -> DataFrame:
    """(kept_id, copy_id) for each further copy of a record, kept_id its smallest item.

    Rows are one record if canonical title and rest are equal (``title_and_rest``). Null titles
    are empty ones; rows without a letter or digit in ``text``, null texts included, and rows of
    a null item are left out; an item that stands twice is one row. A record that a third of
    all rows repeat is joined to its kept item by broadcast.
    """
    rows = canonical_records(df, item, title, text)
    encoded = materialize(encode(rows, "item", ["f0", "f1"]), "encoded")
    total = rows.count()
    groups = collapse(encoded, "item").where("copies > 1")
    found = lookup(encoded, groups, ["fields_ids"], F.col("copies") >= F.lit(HOT_SHARE * total))
    return found.where("item <> kept").select(F.col("kept").alias("kept_id"), F.col("item").alias("copy_id"))
