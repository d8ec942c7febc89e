"""Problem 2: how distinctive each term of a record is, by a parsimonious language model.

A record's text is taken as drawn from a mixture of its own model P(t|D) and the background
P(t|C) of the whole collection; expectation-maximisation moves to the background the mass that
it explains well, and the converged P(t|D) ranks the record's terms (``ranked_terms``). The
background is the share of each term among all (record, distinct term) pairs, n_t / sum(n).
``distinctive_terms`` weighs what the model keeps.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.operators.skew import HOT_SHARE, lookup
from rankmill.operators.storage import materialize, spread

TERM = "[a-z0-9]+"
#: Weight of the record's own model in the mixture.
OWN = 0.1
#: A term below this probability that the model would shrink further is given to the background.
FLOOR = 1e-4
ROUNDS = 30
#: A vocabulary of up to so many terms (about 100 MB in a worker) is broadcast; a larger one is joined.
MAX_BROADCAST_TERMS = 1_000_000

_vocabularies: dict[str, tuple[dict[str, int], np.ndarray]] = {}


def ascii_terms(text: Column) -> Column:
    """The maximal runs of a-z and 0-9 of a text of ASCII characters alone; null for other texts and null."""
    return F.when(F.length(text) == F.octet_length(text), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def vocabulary(corpus: DataFrame, text: str) -> DataFrame:
    """(term, n): the records that hold each term; under the empty term, all records that have one."""
    terms = F.array_distinct(ascii_terms(F.col(text)))
    rows = corpus.select(terms.alias("ts")).where(F.size("ts") > 0)
    return rows.select(F.explode(F.concat(F.array(F.lit("")), "ts")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def parsimonious(rec: np.ndarray, tf: np.ndarray, background: np.ndarray, n_rec: int, own: float = OWN, floor: float = FLOOR, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Converged P(t|D) of each (record, term), and whether the term survives.

    A term is dropped only if its probability is under ``floor`` and its own count can't raise
    it again: tf * own <= S * ((1 - own) * P(t|C) + own * floor), where S is the mass that the
    record keeps; see ``dropped_at_most``.
    """
    length = np.bincount(rec, weights=tf, minlength=n_rec)
    p = tf / length[rec]
    base = (1 - own) * background
    mass = length
    for _ in range(rounds):
        e = tf * (own * p) / (own * p + base)
        mass = np.bincount(rec, weights=e, minlength=n_rec)
        p = e / mass[rec]
    dropped = (p < floor) & (tf * own <= mass[rec] * (base + own * floor))
    return np.where(dropped, 0.0, p), ~dropped


def dropped_at_most(length: np.ndarray, n_records: int, terms_per_record: float, own: float = OWN, floor: float = FLOOR) -> np.ndarray:
    """No dropped term of a record of ``length`` terms weighs more than this (weight: tf * ln(N / n)).

    A dropped term has tf <= length * (c * P(t|C) + floor), c = (1 - own) / own, and with
    P(t|C) = n / (N * M), M distinct terms a record, P(t|C) * ln(N / n) is at most 1 / (e * M).
    """
    return length * ((1 - own) / own / (math.e * terms_per_record) + floor * math.log(max(n_records, 2)))


def heaviest(rec: np.ndarray, code: np.ndarray, tf: np.ndarray, n: np.ndarray, n_rec: int, n_records: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each record that has a term: the record and the position of its heaviest term.

    The model's survivors are weighed exactly (tf * ln(N / n), six decimals, ties to the
    smaller code). Where the heaviest survivor doesn't reach the bound on dropped terms, all
    the record's terms are weighed.
    """
    _, alive = parsimonious(rec, tf, n / pairs, n_rec)
    weight = np.round(tf * np.log(n_records / n), 6)
    length = np.bincount(rec, weights=tf, minlength=n_rec)
    best = np.full(n_rec, -1.0)
    np.maximum.at(best, rec[alive], weight[alive])
    unsure = best < dropped_at_most(length, n_records, pairs / n_records)
    kept = np.flatnonzero(alive | unsure[rec])
    order = kept[np.lexsort((code[kept], -weight[kept], rec[kept]))]
    first = np.ones(len(order), dtype=bool)
    first[1:] = rec[order][1:] != rec[order][:-1]
    return rec[order[first]], order[first]


def ranked(rec: np.ndarray, code: np.ndarray, tf: np.ndarray, n: np.ndarray, n_rec: int, pairs: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Record, position, probability and place of each term that the models keep."""
    p, alive = parsimonious(rec, tf, n / pairs, n_rec)
    p = np.round(p, digits)
    order = np.flatnonzero(alive)
    order = order[np.lexsort((code[order], -p[order], rec[order]))]
    who = rec[order]
    began = np.searchsorted(who, who)  # ``who`` is sorted
    return who, order, p[order], (np.arange(len(order)) - began + 1).astype(np.int32)


def _counts(texts: list[str | None], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, term code, count) of a batch, sorted by record and code; terms not in ``index`` are left out."""
    import re

    find, get = re.compile(TERM).findall, index.get
    codes, lengths = [], []
    for t in texts:
        own = [get(x, -1) for x in find(t)] if t is not None and t.isascii() else []
        codes += own
        lengths.append(len(own))
    code = np.array(codes, dtype=np.int64)
    rec = np.repeat(np.arange(len(texts)), lengths)
    known = code >= 0
    size = max(len(index), 1)
    key, tf = np.unique(rec[known] * size + code[known], return_counts=True)
    return key // size, key % size, tf.astype(np.float64)


_SCHEMA = "kind string, rec_id string, term string"


def _named(records: DataFrame, kind: str, rec_id: str, text: str) -> DataFrame:
    return records.select(F.lit(kind).alias("kind"), F.col(rec_id).cast("string").alias("rec_id"), F.col(text).alias("text"))


def collection(*parts: tuple[DataFrame, str, str, str]) -> DataFrame:
    """One table (kind, rec_id, text) of several, each given as (table, kind, id column, text column); a pass then serves all."""
    out = _named(*parts[0])
    for p in parts[1:]:
        out = out.unionByName(_named(*p))
    return out


def distinctive_terms(records: DataFrame, vocab: DataFrame, max_broadcast_terms: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """Each record's heaviest term: ``kind``, ``rec_id``, ``term``, out of the terms that its parsimonious model keeps.

    ``records`` is what ``collection`` gave, ``vocab`` what ``vocabulary`` gave, materialised. Texts that are null, empty, without a
    term or not of ASCII alone have no row; neither have records none of whose terms occurs
    in the collection. Ties go to the alphabetically first term; repeated records are each
    scored; an empty collection or table gives no rows.
    """
    return _modelled(records, vocab, max_broadcast_terms, heaviest, _SCHEMA)


def ranked_terms(records: DataFrame, vocab: DataFrame, max_broadcast_terms: int = MAX_BROADCAST_TERMS, digits: int = 6) -> DataFrame:
    """``kind``, ``rec_id``, ``term``, ``probability`` and ``place`` (from 1): all terms that each record's model keeps, most probable first.

    Probabilities are rounded before they are compared, ties go to the alphabetically first
    term. Which records and terms take part, and what odd inputs give, is as in ``distinctive_terms``.
    """

    def rank(rec, code, tf, n, n_rec, n_records, pairs):
        return ranked(rec, code, tf, n, n_rec, pairs, digits)

    return _modelled(records, vocab, max_broadcast_terms, rank, f"{_SCHEMA}, probability double, place int")


def _modelled(records: DataFrame, vocab: DataFrame, max_broadcast_terms: int, pick, schema: str) -> DataFrame:
    head = vocab.where("term = ''").select("n").take(1)
    if not head:
        return records.sparkSession.createDataFrame([], schema)
    n_records = head[0].n
    terms = vocab.where("term <> ''")
    size, pairs = terms.agg(F.count("*"), F.sum("n")).first()
    run = _by_broadcast if size <= max_broadcast_terms else _by_join
    return run(records, terms, n_records, pairs, pick, schema)


def _by_broadcast(records: DataFrame, terms: DataFrame, n_records: int, pairs: int, pick, schema: str) -> DataFrame:
    sent = records.sparkSession.sparkContext.broadcast(terms.toArrow().sort_by("term"))
    key = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _vocabularies:
            _vocabularies.clear()
            names = sent.value.column("term").to_pylist()
            _vocabularies[key] = ({t: i for i, t in enumerate(names)}, sent.value.column("n").to_numpy(), names)
        index, n, names = _vocabularies[key]
        for batch in batches:
            rec, code, tf = _counts(batch.column(2).to_pylist(), index)
            if not len(rec):
                continue
            who, at, *more = pick(rec, code, tf, n[code], batch.num_rows, n_records, pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), pa.array([names[c] for c in code[at]], pa.string()), *map(pa.array, more)], names=columns)

    columns = [c.split()[0] for c in schema.split(", ")]
    return spread(records).mapInArrow(score, schema)


def _by_join(records: DataFrame, terms: DataFrame, n_records: int, pairs: int, pick, schema: str) -> DataFrame:
    """The same with the background joined. Few terms can stand in a thousandth of the records (1000 x terms a record)."""
    rows = materialize(records.withColumn("__row", F.monotonically_increasing_id()), "records")
    counts = rows.select("kind", "rec_id", "__row", F.explode(ascii_terms(F.col("text"))).alias("term")).groupBy("kind", "rec_id", "__row", "term").agg(F.count("*").alias("tf"))
    known = lookup(counts, terms, ["term"], F.col("n") >= HOT_SHARE * n_records)
    grouped = known.groupBy("kind", "rec_id", "__row").agg(F.sort_array(F.collect_list(F.struct("term", "tf", "n"))).alias("ts"))
    flat = grouped.select("kind", "rec_id", F.col("ts.term").alias("term"), F.col("ts.tf").alias("tf"), F.col("ts.n").alias("n"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [batch.column(i) for i in (2, 3, 4)]
            sizes = np.diff(lists[0].offsets.to_numpy())
            rec = np.repeat(np.arange(batch.num_rows), sizes)
            names, tf, n = (x.flatten() for x in lists)
            code = np.arange(len(rec))  # sorted by term within a record
            who, at, *more = pick(rec, code, tf.to_numpy().astype(np.float64), n.to_numpy(), batch.num_rows, n_records, pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), names.take(pa.array(at)), *map(pa.array, more)], names=columns)

    columns = [c.split()[0] for c in schema.split(", ")]
    return flat.mapInArrow(score, schema)
