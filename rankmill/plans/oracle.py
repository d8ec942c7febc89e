"""SQL for DuckDB of the registered queries, built from shared common table expressions."""

from __future__ import annotations

KS, GRID, POOL = (5, 10, 20, 50, 100), (5, 10, 20, 50), 100
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TRIMMED = rf"trim(regexp_replace(coalesce(text_raw, ''), '{SPACE}', ' ', 'g'))"
ABBREV = r"(^|[^\p{L}\p{N}_])[A-Z]{2,6}($|[^\p{L}\p{N}_])"
KEY = "sha256(lower(trim(coalesce(title, ''))) || '||' || trim(coalesce(text_norm, '')))"
STRIPPED = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text_raw, ''), '<[^>]+>', ' ', 'g'), '\$[^$]*\$', ' ', 'g'), '\\[a-zA-Z]+\{{[^}}]*\}}', ' ', 'g'), '{SPACE}', ' ', 'g'))"""


def _run(stage: str, depth: int | None = None) -> str:
    cut = f"QUALIFY rank <= {depth}" if depth else ""
    return f"""run_{stage}{depth or ""} AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, logged ASC NULLS LAST, doc_id) AS INTEGER) AS rank, score
  FROM (SELECT query_id, doc_id, max(score) AS score, min(rank) AS logged FROM runs WHERE stage = '{stage}' AND query_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL) {cut})"""


def _rrf(name: str, first: str, second: str, k: int) -> str:
    return f"""{name} AS (SELECT query_id, doc_id, rrf, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, r0 ASC NULLS LAST, r1 ASC NULLS LAST, doc_id) AS INTEGER) AS rank FROM
  (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, min(rank) FILTER (list = 0) AS r0, min(rank) FILTER (list = 1) AS r1
   FROM (SELECT query_id, doc_id, rank, 0 AS list FROM {first} UNION ALL SELECT query_id, doc_id, rank, 1 FROM {second}) GROUP BY ALL) QUALIFY rank <= {k})"""


def _scored(name: str, pool: str) -> str:
    words = "list_distinct(regexp_extract_all(lower({0}), '[a-z]{{4,}}'))".format
    toks = "len(regexp_extract_all(lower({0}), '[a-z0-9]+'))".format
    return f"""{name} AS (SELECT query_id, doc_id, p.rank AS stage1_rank,
    round(len(list_intersect({words("q")}, {words("t")}))::DOUBLE / greatest(len({words("q")}), 1) + 0.1::DOUBLE / (1.0::DOUBLE + {toks("t")}), 9) AS score, CAST({toks("q")} + {toks("t")} + 3 AS INTEGER) AS n_tokens_before_truncation
  FROM {pool} p JOIN (SELECT query_id, coalesce(query_raw, '') AS q FROM queries) USING (query_id) JOIN (SELECT doc_id, coalesce(text_raw, '') AS t FROM corpus) USING (doc_id))"""


def _dense(name: str, pool: str) -> str:
    words = "list_distinct(regexp_extract_all(lower({0}), '[a-z]{{4,}}'))".format
    return f"""{name} AS (SELECT query_id, doc_id, p.rank AS stage1_rank, round(len(list_intersect({words("q")}, {words("t")}))::DOUBLE / greatest(len({words("t")}), 1), 9) AS score
  FROM {pool} p JOIN (SELECT query_id, coalesce(query_raw, '') AS q FROM queries) USING (query_id) JOIN (SELECT doc_id, coalesce(text_raw, '') AS t FROM corpus) USING (doc_id))"""


def _rerun(name: str, scored: str, k: int) -> str:
    return f"""{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, stage1_rank) AS INTEGER) AS rank FROM {scored} WHERE stage1_rank <= {k})"""


def _ideal(name: str, k: int) -> str:
    return f"""{name} AS (SELECT query_id, count(*) AS n_relevant, sum(CASE WHEN pos <= {k} THEN relevance / log2(pos + 1.0::DOUBLE) END) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS pos FROM judged WHERE relevance > 0) GROUP BY 1)"""


def _eval(name: str, run: str, k: int, ideal: str, asked: str | None = None, join: str = "JOIN") -> str:
    return f"""{name} AS (SELECT query_id, coalesce(hits, 0)::DOUBLE / {k} AS precision, least(coalesce(n_relevant, 0), {k})::DOUBLE / {k} AS precision_ceiling,
    CASE WHEN coalesce(n_relevant, 0) > 0 THEN coalesce(hits, 0)::DOUBLE / n_relevant ELSE 0.0::DOUBLE END AS recall, coalesce(1.0::DOUBLE / first_rank, 0.0::DOUBLE) AS mrr, CASE WHEN idcg > 0 THEN coalesce(dcg, 0.0::DOUBLE) / idcg ELSE 0.0::DOUBLE END AS ndcg
  FROM (SELECT DISTINCT query_id FROM {asked or run}) {join} {ideal} USING (query_id) LEFT JOIN
    (SELECT query_id, count(*) FILTER (rank <= {k} AND relevance > 0) AS hits, min(rank) FILTER (relevance > 0) AS first_rank, sum(relevance / log2(rank + 1.0::DOUBLE)) FILTER (rank <= {k}) AS dcg
     FROM {run} JOIN judged USING (query_id, doc_id) GROUP BY 1) USING (query_id))"""


def _ceiling(stage: str) -> str:
    return f"""ceiling_{stage} AS (SELECT k, avg(coalesce(hits, 0)::DOUBLE / n) AS recall, count(*) AS n_queries, avg(CASE WHEN hits > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS pct_queries_with_hit
  FROM (SELECT unnest({list(KS)})::INTEGER AS k) CROSS JOIN (SELECT DISTINCT query_id FROM run_{stage}{POOL}) JOIN (SELECT query_id, count(*) AS n FROM judged WHERE relevance > 0 GROUP BY 1) USING (query_id)
  LEFT JOIN (SELECT query_id, kk AS k, count(*) AS hits FROM run_{stage}{POOL} JOIN judged USING (query_id, doc_id) CROSS JOIN (SELECT unnest({list(KS)})::INTEGER AS kk) WHERE relevance > 0 AND rank <= kk GROUP BY ALL) USING (query_id, k) GROUP BY k)"""


BASE = ",\n".join(
    [
        "WITH judged AS (SELECT query_id, doc_id, max(relevance) AS relevance FROM qrels WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND relevance IS NOT NULL GROUP BY ALL)",
        *[_run(s, depth) for s in ("bm25", "dense", "hybrid") for depth in (None, POOL)],
        _rrf("fused", "run_bm25100", "run_dense100", 20),
        _rrf("fused50", "run_bm25100", "run_dense100", 50),
        "dtok AS (SELECT doc_id, corpus_ord, regexp_extract_all(lower(coalesce(text_norm, '')), '[a-z0-9]+') AS ts FROM corpus)",
        "totals AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM dtok)",
        "tf AS (SELECT doc_id, corpus_ord, len(ts) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(ts) AS term FROM dtok) GROUP BY ALL)",
        "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)",
        "raw_idf AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df CROSS JOIN totals)",
        "idf AS (SELECT term, df, CASE WHEN raw > 0 THEN raw ELSE 0.25 * (SELECT avg(raw) FROM raw_idf) END AS idf FROM raw_idf)",
        "qtok AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(coalesce(query_norm, '')), '[a-z0-9]+')) AS term FROM queries WHERE query_id IS NOT NULL) GROUP BY ALL)",
        "bm AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM qtok JOIN idf USING (term) JOIN tf USING (term) CROSS JOIN totals GROUP BY ALL)",
        "bm_all AS (SELECT q.query_id, c.doc_id, c.corpus_ord, round(coalesce(score, 0.0::DOUBLE), 9) AS score FROM (SELECT DISTINCT query_id FROM queries WHERE query_id IS NOT NULL) q CROSS JOIN corpus c LEFT JOIN bm ON bm.query_id = q.query_id AND bm.doc_id = c.doc_id)",
        "bm_top AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_ord, doc_id) AS INTEGER) AS rank FROM bm_all QUALIFY rank <= 100)",
        _rrf("hybrid_own", "bm_top", "run_dense100", 20),
        _scored("scored", "fused"),
        _scored("scored50", "fused50"),
        _dense("dense50", "fused50"),
        _rerun("rerun", "scored", 20),
        "stage1 AS (SELECT query_id, doc_id, stage1_rank AS rank FROM scored)",
        _ideal("ideal5", 5),
        _ideal("ideal10", 10),
        _eval("ev1", "stage1", 5, "ideal5"),
        _eval("ev2", "rerun", 5, "ideal5"),
        "pairs AS (SELECT query_id, ev1.ndcg AS stage1, ev2.ndcg AS stage2, ev2.ndcg - ev1.ndcg AS delta FROM ev1 JOIN ev2 USING (query_id))",
        *map(_ceiling, ("bm25", "dense", "hybrid")),
        *[_eval(f"ev_{s}", f"run_{s}", 5, "ideal5") for s in ("bm25", "dense", "hybrid")],
        _eval("ev_all", "run_bm25", 10, "ideal10", "queries", "LEFT JOIN"),
        """deltas AS (SELECT query_id, coalesce(query_raw, '') AS query, doc_id, coalesce(title, '') AS doc_title, a.rank AS rank_stage1, b.rank AS rank_ce, a.rank - b.rank AS delta, coalesce(relevance > 0, FALSE) AS is_relevant, coalesce(n_tokens > 512, FALSE) AS was_truncated
  FROM stage1 a FULL JOIN rerun b USING (query_id, doc_id) LEFT JOIN queries USING (query_id) LEFT JOIN corpus USING (doc_id) LEFT JOIN judged USING (query_id, doc_id))""",
    ]
)
METRICS = ", ".join(f"round({m}, 9) AS {m}" for m in ("precision", "precision_ceiling", "recall", "mrr", "ndcg"))
MEANS = ", ".join(f"round(avg({m}), 9) AS {m}" for m in ("precision", "precision_ceiling", "recall", "mrr", "ndcg"))
PCT = "round(CASE WHEN avg(precision_ceiling) > 0 THEN avg(precision) / avg(precision_ceiling) END, 9) AS precision_pct_of_ceiling"


def _poisson_thresholds() -> str:
    import math

    total, p, parts = math.exp(-1), math.exp(-1), []
    for k in range(1, 9):
        parts.append(f"(u >= {total!r}::DOUBLE)::INT")
        p /= k
        total += p
    return " + ".join(parts)


_CASE_RULES = """
r1 AS (SELECT 1 AS i, 'relevant_promoted' AS c, query_id, arg_min(note, (v, doc_id)) AS note, min(v) AS v FROM (SELECT query_id, doc_id, -delta AS v, 'doc ' || doc_id || ' moved rank ' || rank_stage1 || '->' || rank_ce AS note FROM deltas WHERE is_relevant AND rank_stage1 > 5 AND rank_ce <= 3) GROUP BY 3),
r2 AS (SELECT 2 AS i, 'irrelevant_demoted' AS c, query_id, arg_min(note, (v, doc_id)) AS note, min(v) AS v FROM (SELECT query_id, doc_id, delta AS v, 'doc ' || doc_id || ' moved rank ' || rank_stage1 || '->' || rank_ce AS note FROM deltas WHERE NOT is_relevant AND rank_stage1 <= 3 AND rank_ce > 5) GROUP BY 3),
r3 AS (SELECT 3 AS i, 'minimal_change' AS c, query_id, 'max |delta| in top-5 = ' || max(abs(delta)) AS note, max(abs(delta)) AS v FROM deltas WHERE (rank_stage1 <= 5 OR rank_ce <= 5) AND delta IS NOT NULL GROUP BY query_id HAVING max(abs(delta)) <= 1),
r4 AS (SELECT 4 AS i, 'failure' AS c, query_id, 'nDCG@5 dropped by ' || printf('%.3f', abs(delta)) AS note, round(delta, 9) AS v FROM pairs WHERE round(delta, 9) < 0),
r5 AS (SELECT 5 AS i, 'terminology_abbreviation' AS c, query_id, 'query contains abbreviation, max |delta| = ' || max(abs(delta)) AS note, -max(abs(delta)) AS v FROM deltas WHERE delta IS NOT NULL AND regexp_matches(query, '""" + ABBREV + """') GROUP BY query_id),
p1 AS (SELECT * FROM r1 ORDER BY v, query_id LIMIT 1),
p2 AS (SELECT * FROM r2 WHERE query_id NOT IN (SELECT query_id FROM p1) ORDER BY v, query_id LIMIT 1),
p3 AS (SELECT * FROM r3 WHERE query_id NOT IN (SELECT query_id FROM p1 UNION SELECT query_id FROM p2) ORDER BY v, query_id LIMIT 1),
p4 AS (SELECT * FROM r4 WHERE query_id NOT IN (SELECT query_id FROM p1 UNION SELECT query_id FROM p2 UNION SELECT query_id FROM p3) ORDER BY v, query_id LIMIT 1),
p5 AS (SELECT * FROM r5 WHERE query_id NOT IN (SELECT query_id FROM p1 UNION SELECT query_id FROM p2 UNION SELECT query_id FROM p3 UNION SELECT query_id FROM p4) ORDER BY v, query_id LIMIT 1),
picked AS (SELECT c AS "case", query_id, note FROM p1 UNION ALL SELECT c, query_id, note FROM p2 UNION ALL SELECT c, query_id, note FROM p3 UNION ALL SELECT c, query_id, note FROM p4 UNION ALL SELECT c, query_id, note FROM p5)
"""

_WILCOXON = """d AS (SELECT round(delta, 9) AS d FROM pairs WHERE round(delta, 9) <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d),
s AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0.0::DOUBLE) AS p, coalesce(sum(r) FILTER (d < 0), 0.0::DOUBLE) AS m FROM r),
w AS (SELECT n AS n_nonzero, p AS w_pos, m AS w_neg, least(p, m) AS w_stat, CASE WHEN n > 0 THEN (p - n * (n + 1) / 4.0::DOUBLE - 0.5::DOUBLE * CASE WHEN p > n * (n + 1) / 4.0::DOUBLE THEN 1 ELSE -1 END) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE) ELSE 0.0::DOUBLE END AS z FROM s)"""
# erf by its series of positive terms.
_P = "CASE WHEN n_nonzero = 0 OR z = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 200), lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln(abs(z) / sqrt(2)) + lgamma(n + 1) - lgamma(2 * n + 2)))) END"

MODELS = {"overlap": "scored50", "density": "dense50"}
_grid_ctes = ",\n".join(x for m, s in MODELS.items() for k in GRID for x in (_rerun(f"{m}{k}", s, k), _eval(f"{m}_at{k}", f"{m}{k}", 5, "ideal5", "fused50")))
GRID_ROWS = " UNION ALL ".join(f"SELECT '{m}' AS model, {k} AS k, round(avg(ndcg), 9) AS ndcg, round(avg(mrr), 9) AS mrr, count(*) AS n_queries FROM {m}_at{k}" for m in MODELS for k in GRID)

CUES = ["no ", "not ", "fails to", "failed to", "does not", "did not", "cannot", "can not", "without", "lack of", "absence of", "none of", "neither", "unable to", "no evidence"]
_short_names = r"coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,6}}')))), ', '), '')".format
_failure_ctes = f"""failed AS (SELECT query_id FROM pairs ORDER BY round(delta, 9), query_id LIMIT 5),
own AS (SELECT * FROM deltas JOIN failed USING (query_id)),
target AS (SELECT query_id, doc_id, was_truncated FROM own QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY NOT is_relevant, coalesce(rank_stage1, 2147483647), doc_id) = 1),
wrong AS (SELECT query_id, lower(coalesce(text_raw, '')) AS low FROM (SELECT query_id, doc_id FROM own WHERE NOT is_relevant QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rank_ce, 2147483647), doc_id) = 1) LEFT JOIN corpus USING (doc_id)),
cues AS (SELECT unnest({CUES}) AS cue, unnest(range(1, {len(CUES)} + 1)) AS place),
told AS (SELECT query_id, coalesce(query_raw, '') AS q FROM failed LEFT JOIN queries USING (query_id)),
near AS (SELECT query_id, cue, list_sort(list_intersect(list_distinct(list_transform(regexp_extract_all(q, '[a-zA-Z]{{4,}}'), lambda x: lower(x))), list_distinct(regexp_extract_all(substr(low, greatest(1, i - 60), i - greatest(1, i - 60) + length(cue) + 60), '[a-zA-Z]{{4,}}')))) AS words, place, i
  FROM (SELECT query_id, low, unnest(range(1, length(low) + 1)) AS i FROM wrong) JOIN told USING (query_id) JOIN cues ON substr(low, i, length(cue)) = cue),
negated AS (SELECT query_id, cue, words FROM near WHERE len(words) > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place, i) = 1),
shown AS (SELECT query_id, q, target.doc_id, coalesce(was_truncated, FALSE) AS cut, regexp_matches(q, '{ABBREV}') AS short, cue, words FROM told LEFT JOIN target USING (query_id) LEFT JOIN negated USING (query_id)),
classified AS (SELECT query_id, q AS query, coalesce(nullif(concat_ws(', ', CASE WHEN cut THEN 'long_document_truncation' END, CASE WHEN short THEN 'abbreviation_ambiguity' END, CASE WHEN cue IS NOT NULL THEN 'negation_context_misreading' END), ''), 'topic_or_entity_mismatch (requires manual annotation)') AS causes,
  coalesce(nullif(concat_ws(' | ', CASE WHEN cut THEN 'doc ' || doc_id || ' was_truncated=True' END, CASE WHEN short THEN 'query contains abbreviation(s): ' || {_short_names("q")} END, CASE WHEN cue IS NOT NULL THEN 'negation cue ''' || cue || ''' near query term(s): ' || array_to_string(words, ', ') END), ''), 'none of the automated checks fired') AS evidence,
  CAST(cut::INT + short::INT + (cue IS NOT NULL)::INT AS INTEGER) AS n_automated_causes FROM shown)"""
_hashed = "list_transform(range(0, 64), lambda d: len(list_filter(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda t: (length(t) * 31 + ascii(t) * 7 + ascii(right(t, 1)) * 13) % 64), lambda p: p = d))::DOUBLE)".format
_unit = "CASE WHEN list_sum(list_transform(v, lambda x: x * x)) > 0 THEN list_transform(v, lambda x: (x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::FLOAT::DOUBLE) ELSE v END"
_hybrid_ctes = f"""dv AS MATERIALIZED (SELECT doc_id, {_unit} AS v FROM (SELECT doc_id, {_hashed("text_norm")} AS v FROM corpus)),
qv AS MATERIALIZED (SELECT query_id, {_unit} AS v FROM (SELECT query_id, {_hashed("query_raw")} AS v FROM queries WHERE query_id IS NOT NULL)),
hashed_top AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, round(list_dot_product(qv.v, dv.v), 6) AS score FROM qv, dv) QUALIFY rank <= 100),
rtok AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(coalesce(query_raw, '')), '[a-z0-9]+')) AS term FROM queries WHERE query_id IS NOT NULL) GROUP BY ALL),
rbm AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM rtok JOIN idf USING (term) JOIN tf USING (term) CROSS JOIN totals GROUP BY ALL),
rbm_top AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_ord, doc_id) AS INTEGER) AS rank
  FROM (SELECT q.query_id, c.doc_id, c.corpus_ord, round(coalesce(score, 0.0::DOUBLE), 9) AS score FROM (SELECT DISTINCT query_id FROM queries WHERE query_id IS NOT NULL) q CROSS JOIN corpus c LEFT JOIN rbm ON rbm.query_id = q.query_id AND rbm.doc_id = c.doc_id) QUALIFY rank <= 100),
{_rrf("hybrid_both", "rbm_top", "hashed_top", 20)}"""
_abbreviation_ctes = rf"""pieces AS (SELECT doc_id, text_raw, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, text_raw, regexp_extract_all(text_raw, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS ps FROM corpus WHERE text_raw IS NOT NULL)),
placed AS (SELECT *, 1 + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM pieces),
sides AS (SELECT piece AS abbreviation, substr(text_raw, greatest(1, start - 30), start - greatest(1, start - 30)) AS b, substr(text_raw, start + length(piece), 30) AS a FROM placed WHERE regexp_full_match(piece, '[A-Z]{{2,6}}')),
contexts AS (SELECT abbreviation, lower(coalesce(nullif(regexp_extract(a, '^[-( ]*(?:{SPACE})?([a-zA-Z][a-zA-Z-]{{3,}})', 1), ''), regexp_extract_all(b, '[a-zA-Z][a-zA-Z-]{{3,}}')[-1])) AS word FROM sides),
chosen AS (SELECT abbreviation, count(*) AS n_occurrences, count(DISTINCT word) AS n_distinct_nearby_words, list_sort(list_distinct(list(word) FILTER (word IS NOT NULL)))[:8] AS sample FROM contexts GROUP BY 1
  HAVING count(DISTINCT word) >= 2 AND count(*) BETWEEN 3 AND 40 ORDER BY count(DISTINCT word)::DOUBLE / count(*) DESC, abbreviation LIMIT 10)"""

SQL = {
    "markup_stripped": f"SELECT doc_id, {STRIPPED} AS text FROM corpus",
    "dedup_keep_first": f"SELECT doc_id, corpus_ord, {KEY} AS dedup_key FROM corpus QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY corpus_ord) = 1",
    "token_stats": rf"""SELECT doc_id, CAST(CASE WHEN {TRIMMED} = '' THEN 0 ELSE len(string_split({TRIMMED}, ' ')) END AS INTEGER) AS n_white,
  CAST(len(regexp_extract_all(lower(coalesce(text_raw, '')), '[a-z0-9]+')) AS INTEGER) AS n_terms, CAST(len(list_distinct(regexp_extract_all(lower(coalesce(text_raw, '')), '[a-z]{{4,}}'))) AS INTEGER) AS n_content FROM corpus""",
    "length_summary": rf"""SELECT round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, round(avg(CASE WHEN n > 512 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pct_over, max(n) AS n_max, min(n) AS n_min
  FROM (SELECT CAST(CASE WHEN {TRIMMED} = '' THEN 0 ELSE len(string_split({TRIMMED}, ' ')) END AS INTEGER) AS n FROM corpus)""",
    "queries_semi": "SELECT query_id, query_raw FROM queries WHERE query_id IN (SELECT query_id FROM qrels)",
    "qrels_semi": "SELECT query_id, doc_id, relevance FROM qrels WHERE doc_id IN (SELECT doc_id FROM corpus)",
    "queries_with_several_judgments": "SELECT count(*) AS n_multi FROM (SELECT query_id FROM qrels GROUP BY query_id HAVING count(*) > 1)",
    "term_df_idf": f"{BASE} SELECT term, df, round(idf, 9) AS idf FROM idf",
    "bm25_scores": f"{BASE} SELECT query_id, doc_id, round(score, 6) AS score FROM bm",
    "bm25_topk": f"{BASE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm_top WHERE rank <= 20",
    "dense_topk": """SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM
  (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0) QUALIFY rank <= 20""",
    "rrf_hybrid_topk": f"{BASE} SELECT query_id, doc_id, round(rrf, 9) AS rrf, rank FROM fused",
    "hybrid_topk": f"{BASE} SELECT query_id, doc_id, round(rrf, 9) AS rrf, rank FROM hybrid_own",
    "packed_runs": f"{BASE} SELECT query_id, string_agg(doc_id, ' ' ORDER BY rank) AS docs FROM run_hybrid GROUP BY query_id",
    "unpacked_runs": f"{BASE} SELECT query_id, doc_id, rank, 'hybrid' AS stage FROM run_hybrid",
    "rerank_overlap_topk": f"{BASE} SELECT query_id, doc_id, rank, score, n_tokens_before_truncation, n_tokens_before_truncation > 512 AS was_truncated FROM rerun",
    "truncation_rate": f"{BASE} SELECT round(coalesce(avg(CASE WHEN n_tokens_before_truncation > 512 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 0), 9) AS truncation_pct, count(*) AS n_pairs FROM scored",
    "metrics_per_query": f"{BASE} SELECT query_id, {METRICS} FROM ev_hybrid",
    "metrics_unjudged_too": f"{BASE} SELECT query_id, {METRICS} FROM ev_all",
    "metrics_aggregate": f"{BASE} " + " UNION ALL ".join(f"SELECT {MEANS}, {PCT}, count(*) AS n_queries, '{s}' AS method FROM ev_{s}" for s in ("bm25", "dense", "hybrid")),
    "recall_ceiling": f"{BASE} SELECT k, round(recall, 9) AS recall, n_queries, round(pct_queries_with_hit, 9) AS pct_queries_with_hit FROM ceiling_hybrid",
    "recall_ceiling_pivot": f"{BASE} SELECT k, round(a.recall, 9) AS bm25, round(b.recall, 9) AS dense, round(c.recall, 9) AS hybrid FROM ceiling_bm25 a JOIN ceiling_dense b USING (k) JOIN ceiling_hybrid c USING (k)",
    "per_query_deltas": f"{BASE} SELECT query_id, round(stage1, 9) AS stage1, round(stage2, 9) AS stage2, round(delta, 9) AS delta FROM pairs",
    "compare_runs": f"""{BASE} SELECT count(*) AS n_queries, round(avg(stage1), 9) AS baseline_mean, round(avg(stage2), 9) AS treatment_mean, round(avg(delta), 9) AS mean_delta, count(*) FILTER (delta > 1e-9) AS n_improved, count(*) FILTER (delta < -1e-9) AS n_degraded,
  count(*) FILTER (abs(delta) <= 1e-9) AS n_unchanged, round(100.0::DOUBLE * count(*) FILTER (delta > 1e-9) / count(*), 9) AS pct_improved, round(100.0::DOUBLE * count(*) FILTER (delta < -1e-9) / count(*), 9) AS pct_degraded FROM pairs""",
    "grid_k": f"{BASE},\n{_grid_ctes}\n{GRID_ROWS}",
    "grid_gap": f"""{BASE},\n{_grid_ctes}, g AS ({GRID_ROWS}), gaps AS (SELECT k, max(ndcg) FILTER (model = 'density') - max(ndcg) FILTER (model = 'overlap') AS gap FROM g GROUP BY k)
SELECT min(k) AS k_min, max(k) AS k_max, round(arg_min(gap, k), 9) AS gap_at_min, round(arg_max(gap, k), 9) AS gap_at_max, arg_max(gap, k) > arg_min(gap, k) AS widens FROM gaps""",
    "hybrid_own_topk": f"{BASE},\n{_hybrid_ctes} SELECT query_id, doc_id, round(rrf, 9) AS rrf, rank FROM hybrid_both",
    "ambiguous_abbrevs": f"WITH {_abbreviation_ctes} SELECT abbreviation, n_occurrences, n_distinct_nearby_words, array_to_string(sample, ', ') AS sample_nearby_words FROM chosen",
    "pair_trace": f"""{BASE}, one AS (SELECT query_id, query, doc_id, list_concat(['[CLS]'], regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9]+'), ['[SEP]'], regexp_extract_all(lower(t), '[a-z0-9]+'))[:511] AS ts, n_tokens_before_truncation, score
  FROM scored JOIN (SELECT query_id, query_raw AS query FROM queries) USING (query_id) JOIN (SELECT doc_id, coalesce(text_raw, '') AS t FROM corpus) USING (doc_id) WHERE stage1_rank = 1)
SELECT query_id, query, doc_id, array_to_string(ts, ' ') || ' [SEP]' AS tokens, n_tokens_before_truncation, n_tokens_before_truncation > 512 AS was_truncated, score AS logit FROM one""",
    "failure_causes": f"{BASE},\n{_failure_ctes} SELECT query_id, query, causes, evidence, n_automated_causes FROM classified",
    "cause_histogram": f"{BASE},\n{_failure_ctes} SELECT cause, count(*) AS count FROM (SELECT unnest(string_split(causes, ', ')) AS cause FROM classified) GROUP BY cause",
    "truncated_failures": f"{BASE},\n{_failure_ctes} SELECT count(*) FILTER (contains(causes, 'long_document_truncation')) AS n_truncated, count(*) AS n_failures FROM classified",
    "metrics_mrr_cut": f"""{BASE} SELECT query_id, round(coalesce(1.0::DOUBLE / min(rank) FILTER (relevance > 0 AND rank <= 5), 0.0::DOUBLE), 9) AS mrr FROM run_bm25 LEFT JOIN judged USING (query_id, doc_id)
WHERE query_id IN (SELECT query_id FROM judged WHERE relevance > 0) GROUP BY query_id""",
    "wilcoxon_stats": f"{BASE}, {_WILCOXON} SELECT n_nonzero, w_pos, w_neg, w_stat, round(z, 9) AS z FROM w",
    "wilcoxon_p": f"{BASE}, {_WILCOXON} SELECT n_nonzero, w_pos, w_neg, w_stat, round(z, 9) AS z, round({_P}, 9) AS p_value FROM w",
    "bootstrap_hash_ci": f"""{BASE}, x AS (SELECT b, delta, CAST(substr(query_id, 2) AS BIGINT) % 2147483647 AS row FROM pairs CROSS JOIN (SELECT unnest(range(10000)) AS b)),
h AS (SELECT b, delta, ((((b * 1103515245 + row * 12345677 + 42) % 2147483647) * 48271 % 2147483647) * 69621 + b) % 2147483647 / 2147483647::DOUBLE AS u FROM x),
m AS (SELECT b, sum(({_poisson_thresholds()}) * delta) / sum({_poisson_thresholds()}) AS m FROM h GROUP BY b), o AS (SELECT m, row_number() OVER (ORDER BY m) AS i FROM m)
SELECT round(max(m) FILTER (i = 251), 9) AS ci_lower, round(max(m) FILTER (i = 9750), 9) AS ci_upper FROM o""",
    "rank_delta_table": f"{BASE} SELECT * FROM deltas",
    "ndcg_delta": f"{BASE} SELECT query_id, round(stage1, 9) AS ndcg_stage1, round(stage2, 9) AS ndcg_ce, round(delta, 9) AS ndcg_delta FROM pairs",
    "case_selection": f'{BASE}, {_CASE_RULES} SELECT "case", query_id, note, query_raw FROM picked LEFT JOIN queries USING (query_id)',
    "case_evidence": f'''{BASE}, {_CASE_RULES} SELECT "case", query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank_ce ASC NULLS LAST, rank_stage1 ASC NULLS LAST, doc_id) AS INTEGER) AS row, doc_id, rank_stage1, rank_ce, delta, is_relevant
  FROM deltas JOIN picked USING (query_id) QUALIFY row <= 8''',
    "lexical_mismatch": f"""{BASE} SELECT query_id, coalesce(query_raw, '') AS query, doc_id, coalesce(title, '') AS doc_title, coalesce(b.rank::VARCHAR, 'not in top-100') AS bm25_rank, d.rank AS dense_rank
  FROM judged JOIN run_dense100 d USING (query_id, doc_id) LEFT JOIN run_bm25100 b USING (query_id, doc_id) JOIN queries USING (query_id) LEFT JOIN corpus USING (doc_id) WHERE relevance > 0 AND d.rank <= 5 AND (b.rank IS NULL OR b.rank > 15)""",
    "semantic_drift": f"""{BASE} SELECT query_id, coalesce(query_raw, '') AS query, doc_id, coalesce(title, '') AS doc_title, d.rank AS dense_rank
  FROM run_dense100 d JOIN queries USING (query_id) LEFT JOIN corpus USING (doc_id) LEFT JOIN judged j USING (query_id, doc_id) WHERE d.rank <= 3 AND coalesce(relevance, 0) <= 0""",
    "worst5": f"{BASE} SELECT query_id, round(stage1, 9) AS stage1, round(stage2, 9) AS stage2, round(delta, 9) AS delta FROM pairs ORDER BY round(delta, 9), query_id LIMIT 5",
    "truncated_relevant": f"{BASE} SELECT count(*) FILTER (is_relevant AND was_truncated) AS n_relevant_truncated FROM deltas",
    "latency_summary": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, min(value) AS v_min, max(value) AS v_max, count(value) AS n_runs FROM events GROUP BY event_type",
    "abbrev_flag": rf"""SELECT doc_id, regexp_matches(coalesce(text_raw, ''), '{ABBREV}') AS has_abbrev_now,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(title, ''), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,6}}')))), ', '), '') AS title_abbrevs FROM corpus""",
    "prep_counters": rf"""WITH k AS (SELECT text_raw FROM corpus QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY corpus_ord) = 1),
b AS (SELECT count(*) AS n_raw, count(*) FILTER (trim(coalesce(text_raw, '')) = '') AS n_empty_abstract, count(*) FILTER (trim(coalesce(text_raw, '')) = '' AND trim(coalesce(title, '')) <> '') AS n_title_only, count(*) FILTER (regexp_matches(title, '<[^>]+>') OR contains(title, '&')) AS n_html_title, count(*) FILTER (regexp_matches(text_raw, '<[^>]+>') OR contains(text_raw, '&')) AS n_html_abstract,
  count(*) FILTER (regexp_matches(title, '\$[^$]*\$') OR regexp_matches(title, '\\[a-zA-Z]+\{{[^}}]*\}}')) AS n_latex_title, count(*) FILTER (regexp_matches(text_raw, '\$[^$]*\$') OR regexp_matches(text_raw, '\\[a-zA-Z]+\{{[^}}]*\}}')) AS n_latex_abstract FROM corpus),
a AS (SELECT count(*) AS n_kept, count(*) FILTER (regexp_matches(coalesce(text_raw, ''), '{ABBREV}')) AS n_abbrev FROM k)
SELECT *, round(100.0::DOUBLE * n_abbrev / n_kept, 6) AS pct_abbrev, n_raw - n_kept AS n_removed, n_html_title + n_html_abstract AS n_html, n_latex_title + n_latex_abstract AS n_latex FROM a, b""",
}
SQL["lexical_mismatch_top5"] = f"{SQL['lexical_mismatch']} ORDER BY query_id, doc_id LIMIT 5"
SQL["semantic_drift_top5"] = f"{SQL['semantic_drift']} ORDER BY query_id, dense_rank LIMIT 5"
SQL["timing_summary"] = """WITH t AS (SELECT event_type AS operation, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS run, value AS ms FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
u AS (SELECT operation, ms FROM t UNION ALL SELECT 'total', sum(ms) FROM t GROUP BY run HAVING count(DISTINCT operation) = (SELECT count(DISTINCT operation) FROM t) AND (SELECT count(DISTINCT operation) FROM t) > 1)
SELECT operation, round(quantile_cont(ms, 0.5), 3) AS p50_ms, round(quantile_cont(ms, 0.95), 3) AS p95_ms, round(avg(ms), 3) AS mean_ms, round(min(ms), 3) AS min_ms, round(max(ms), 3) AS max_ms, count(*) AS n_runs FROM u GROUP BY 1"""
SQL["read_back_collection"] = f"""{BASE}, numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS line FROM corpus)
SELECT query_id, query_raw AS query_text, doc_id, title, text_raw AS abstract, relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY line) AS INTEGER) AS place FROM judged JOIN numbered USING (doc_id) JOIN queries USING (query_id)"""
SQL["read_back_prepared"] = f"{BASE} SELECT query_id, doc_id, relevance, title, CAST(n_tokens AS VARCHAR) AS n_tokens, query_norm FROM judged JOIN corpus USING (doc_id) JOIN queries USING (query_id)"
SQL["read_back_run"] = f"{BASE} SELECT query_id, doc_id, rank, score FROM run_bm25100"
SQL["read_back_table"] = f"{BASE} SELECT query_id, round(ndcg, 9) AS ndcg, round(mrr, 9) AS mrr FROM ev_dense"
