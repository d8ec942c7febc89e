"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.chunking import split_oversized
from rankmill.llm.distinctive import FLOOR, OWN, ROUNDS, collection, distinctive_terms, ranked_terms, vocabulary
from rankmill.llm.dress import copies_of_records
from rankmill.llm.fuse_scores import fuse, majority_winner, score_pool
from rankmill.llm.leakage import leaked_items
from rankmill.llm.near_items import near_items
from rankmill.llm.stuffing import stuffed_pages
from rankmill.llm.tokenizing import encode_corpus
from rankmill.llm.top_n import top_n_per_group
from rankmill.llm.visual_form import canonical_classes, same_looking_pairs
from rankmill.operators.storage import load, materialize

SCORES = ("bm25", "dense", "rerank")


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """A vocabulary file of the public tokenizers; ``RANKMILL_TOKENIZERS`` names another folder."""
    return os.path.join(folder or os.environ.get("RANKMILL_TOKENIZERS", "/opt/tokenizers"), name)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n_per_group(load(spark, sf_dir, "runs"), ["query_id", "stage"], "doc_id", "score", ["rank"], 10).select("query_id", "stage", "place", "doc_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive_terms(*_records_and_vocabulary(spark, sf_dir))


def p2_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term that each record's model keeps, with its converged probability and place."""
    return ranked_terms(*_records_and_vocabulary(spark, sf_dir))


def _records_and_vocabulary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    corpus, queries = load(spark, sf_dir, "corpus"), load(spark, sf_dir, "queries")
    return collection((corpus, "corpus", "doc_id", "text_norm"), (queries, "queries", "query_id", "query_norm")), materialize(vocabulary(corpus, "text_norm"), "vocabulary")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = score_pool(load(spark, sf_dir, "runs"), load(spark, sf_dir, "reranked"))
    return majority_winner(fuse(pool, "query_id", "doc_id", SCORES), "query_id", "doc_id", SCORES)


def p3_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused ranking itself: each pool document's sum of reciprocal ranks, nine decimals."""
    pool = score_pool(load(spark, sf_dir, "runs"), load(spark, sf_dir, "reranked"))
    return fuse(pool, "query_id", "doc_id", SCORES).select("query_id", "doc_id", F.round("rrf", 9).alias("rrf"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [load(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(i).alias("id"), F.col(x).alias("text")) for t, i, x in (("corpus", "doc_id", "text_raw"), ("queries", "query_id", "query_raw"))]
    return texts[0].unionByName(texts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking_pairs(_texts(spark, sf_dir))


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with the class of the records that have its canonical form, case and look-alike letters folded."""
    return canonical_classes(_texts(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(load(spark, sf_dir, "corpus"), "doc_id", "text_raw", most=512, least=51, overlap=50)


def p5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus at hash landmarks, pieces overlapping by 50 tokens."""
    return split_oversized(load(spark, sf_dir, "corpus"), "doc_id", "text_raw", most=512, least=64, overlap=50, reach=127, only_oversized=False)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies_of_records(load(spark, sf_dir, "corpus"), "doc_id", "title", "text_norm")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(load(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "eval_items"), "item_id", "text", similarity=1.0)


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item in near copy: five-word shingles, 0.8."""
    return near_items(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_reworded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item with up to a fifth of its words changed: 0.6 of the words, by how often each occurs."""
    return near_items(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "eval_items"), "item_id", "text", shingle=1, similarity=0.6, radius=19)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages(load(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_found, p2_ranked, p3_found, p3_fused, p4_found, p4_canonical, p5_found, p5_chunks, p6_found, p7_ids, p8_found, p8_near, p8_reworded, p9_found)}


_POOL = """
pool AS (
  SELECT query_id, doc_id, b, d, r FROM
    (SELECT query_id, doc_id, max(CASE WHEN stage = 'bm25' THEN score END) AS b, max(CASE WHEN stage = 'dense' THEN score END) AS d
     FROM runs WHERE stage IN ('bm25', 'dense') AND score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL)
    JOIN (SELECT query_id, doc_id, max(score) AS r FROM reranked WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL) USING (query_id, doc_id)
  WHERE b IS NOT NULL AND d IS NOT NULL)"""


def _em_rounds() -> str:
    step = "{0} AS MATERIALIZED (SELECT *, e / sum(e) OVER w AS p, sum(e) OVER w AS mass FROM (SELECT kind, rec_id, term, tf, base, tf * ({1} * p) / ({1} * p + base) AS e FROM {2}) WINDOW w AS (PARTITION BY kind, rec_id))"
    return ",\n".join(step.format(f"m{i + 1}", f"{OWN}::DOUBLE", f"m{i}") for i in range(ROUNDS))


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
WITH valid AS (SELECT query_id, stage, doc_id, rank, CASE WHEN score = 0 THEN 0.0 ELSE score END AS score FROM runs
  WHERE query_id IS NOT NULL AND stage IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
once AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY query_id, stage, doc_id ORDER BY score DESC, rank ASC NULLS LAST) = 1)
SELECT query_id, stage, CAST(row_number() OVER (PARTITION BY query_id, stage ORDER BY score DESC, rank ASC NULLS LAST, doc_id) AS INTEGER) AS place, doc_id
FROM once QUALIFY place <= 10""",
        "p2_found": """
WITH c AS (SELECT doc_id AS rec_id, unnest(regexp_extract_all(text_norm, '[a-z0-9]+')) AS term FROM corpus WHERE length(text_norm) = strlen(text_norm)),
q AS (SELECT query_id AS rec_id, unnest(regexp_extract_all(query_norm, '[a-z0-9]+')) AS term FROM queries WHERE length(query_norm) = strlen(query_norm)),
df AS (SELECT term, count(DISTINCT rec_id) AS n FROM c GROUP BY term),
total AS (SELECT count(DISTINCT rec_id) AS records FROM c),
w AS (SELECT kind, rec_id, term, round(count(*) * ln(any_value(records) / any_value(n)), 6) AS weight
  FROM (SELECT 'corpus' AS kind, * FROM c UNION ALL SELECT 'queries' AS kind, * FROM q) JOIN df USING (term) CROSS JOIN total GROUP BY kind, rec_id, term)
SELECT kind, rec_id, term FROM w QUALIFY row_number() OVER (PARTITION BY kind, rec_id ORDER BY weight DESC, term) = 1""",
        "p2_ranked": f"""
WITH c AS (SELECT doc_id AS rec_id, unnest(regexp_extract_all(text_norm, '[a-z0-9]+')) AS term FROM corpus WHERE length(text_norm) = strlen(text_norm)),
q AS (SELECT query_id AS rec_id, unnest(regexp_extract_all(query_norm, '[a-z0-9]+')) AS term FROM queries WHERE length(query_norm) = strlen(query_norm)),
df AS (SELECT term, count(DISTINCT rec_id) AS n FROM c GROUP BY term),
t AS (SELECT kind, rec_id, term, count(*)::DOUBLE AS tf FROM (SELECT 'corpus' AS kind, * FROM c UNION ALL SELECT 'queries' AS kind, * FROM q) GROUP BY ALL),
m0 AS MATERIALIZED (SELECT kind, rec_id, term, tf, (1.0::DOUBLE - {OWN}::DOUBLE) * (n::DOUBLE / (SELECT sum(n) FROM df)) AS base, 0.0::DOUBLE AS e, tf / sum(tf) OVER (PARTITION BY kind, rec_id) AS p, 0.0::DOUBLE AS mass FROM t JOIN df USING (term)),
{_em_rounds()}
SELECT kind, rec_id, term, round(p, 6) AS probability, CAST(row_number() OVER (PARTITION BY kind, rec_id ORDER BY round(p, 6) DESC, term) AS INTEGER) AS place
FROM m{ROUNDS} WHERE NOT (p < {FLOOR}::DOUBLE AND tf * {OWN}::DOUBLE <= mass * (base + {OWN}::DOUBLE * {FLOOR}::DOUBLE))""",
        "p3_found": f"""
WITH {_POOL}, sizes AS (SELECT query_id, count(*) AS m FROM pool GROUP BY 1),
won AS (SELECT x.query_id, x.doc_id, count(*) AS n FROM pool x JOIN pool y ON x.query_id = y.query_id AND x.doc_id <> y.doc_id
  WHERE (x.b > y.b)::INT + (x.d > y.d)::INT + (x.r > y.r)::INT >= 2 GROUP BY ALL)
SELECT query_id, doc_id FROM won JOIN sizes USING (query_id) WHERE m >= 2 AND n = m - 1""",
        "p3_fused": f"""
WITH {_POOL}, ranked AS (SELECT query_id, doc_id, rank() OVER (PARTITION BY query_id ORDER BY b DESC) AS rb,
  rank() OVER (PARTITION BY query_id ORDER BY d DESC) AS rd, rank() OVER (PARTITION BY query_id ORDER BY r DESC) AS rr FROM pool)
SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rb) + 1.0::DOUBLE / (60 + rd) + 1.0::DOUBLE / (60 + rr), 9) AS rrf FROM ranked""",
        "p5_found": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(text_raw, '[^ \t\n]+') AS ts FROM corpus WHERE text_raw IS NOT NULL AND doc_id IS NOT NULL),
o AS (SELECT doc_id, len(ts) AS n, list_filter(range(1, len(ts)), lambda i: regexp_matches(ts[i], '[.!?][)\]"'']*$') AND regexp_matches(ts[i + 1], '^[A-Z]')) AS ends FROM t WHERE len(ts) > 512),
p AS (SELECT doc_id, n, ends, 1 AS piece_no, 1::BIGINT AS first_token, coalesce(list_max(list_filter(ends, lambda e: e BETWEEN 51 AND 512)), 512)::BIGINT AS last_token FROM o
  UNION ALL SELECT doc_id, n, ends, piece_no + 1, last_token - 49, CASE WHEN n - (last_token - 49) + 1 <= 512 THEN n ELSE coalesce(list_max(list_filter(ends, lambda e: e BETWEEN last_token - 49 + 50 AND last_token - 49 + 511)), last_token - 49 + 511) END FROM p WHERE last_token < n)
SELECT doc_id, piece_no, CAST(first_token AS INTEGER) AS first_token, CAST(last_token AS INTEGER) AS last_token FROM p""",
        "p8_found": r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
w AS (SELECT DISTINCT item_id, size, array_to_string(ws[k : k + size - 1], ' ') AS passage FROM (SELECT item_id, ws, least(12, len(ws)) AS size, unnest(range(1, len(ws) - least(12, len(ws)) + 2)) AS k FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
s AS (SELECT DISTINCT size FROM w),
h AS (SELECT doc_id, size, array_to_string(ws[k : k + size - 1], ' ') AS passage FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM d JOIN s ON len(ws) >= size))
SELECT DISTINCT doc_id, item_id FROM h JOIN w USING (size, passage)""",
        "p6_found": r"""
WITH k AS (SELECT doc_id, lower(regexp_replace(coalesce(title, ''), '[^\p{L}\p{N}]+', '', 'g')) AS t, lower(regexp_replace(text_norm, '[^\p{L}\p{N}]+', '', 'g')) AS x FROM corpus),
r AS (SELECT doc_id, t, CASE WHEN starts_with(x, t) THEN substr(x, length(t) + 1) WHEN ends_with(x, t) THEN substr(x, 1, length(x) - length(t)) ELSE x END AS rest FROM k WHERE x <> ''),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY t, rest) AS kept_id FROM r)
SELECT kept_id, doc_id AS copy_id FROM g WHERE doc_id <> kept_id""",
    }
