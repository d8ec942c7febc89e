import math
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankmill.operators import bm25, dense, hybrid, prep, runs
from rankmill.operators.storage import load
from rankmill.plans import catalogue


def reference_bm25(docs, query, k1=1.2, b=0.75, eps=0.25):
    toks = [re.findall("[a-z0-9]+", (t or "").lower()) for t in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = {w: sum(w in t for t in map(set, toks)) for t in toks for w in t}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = eps * sum(raw.values()) / len(raw)
    idf = {w: r if r > 0 else floor for w, r in raw.items()}
    return [sum(idf[w] * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avg)) for w in re.findall("[a-z0-9]+", (query or "").lower()) if w in idf) for t in toks]


@pytest.fixture(scope="module")
def collection(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(20, 120))) for _ in range(60)] + ["", None, "Halfé WORD w1"]
    texts += [f"rare{i} half" if i < 30 else f"rare{i}" for i in range(57)]
    corpus = spark.createDataFrame([(f"d{i:03}", t, i) for i, t in enumerate(texts)], "doc_id string, text_norm string, corpus_ord long").repartition(3)
    asked = [("q1", "w1 w2 w2 unseen"), ("q2", "rare3"), ("q3", "nothing known"), ("q4", None), ("q5", "half w7 rare9"), (None, "w1")]
    return corpus, texts, spark.createDataFrame(asked, "query_id string, query_norm string"), asked


def test_search_equals_full_scan(spark, collection):
    corpus, texts, queries, asked = collection
    got = {}
    for r in bm25.search(corpus, queries, bm25.build(corpus), 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    for q, text in asked:
        if q is None:
            continue
        s = [round(x, 9) for x in reference_bm25(texts, text)]
        order = sorted(range(len(s)), key=lambda i: (-s[i], i))[:7]
        rows = sorted(got[q])
        assert [r[1] for r in rows] == [f"d{i:03}" for i in order]
        assert [r[2] for r in rows] == pytest.approx([s[i] for i in order], abs=1e-8)


def test_scores_by_join_equal_full_scan(spark, collection):
    corpus, texts, queries, asked = collection
    got = {(r.query_id, r.doc_id): r.score for r in bm25.scores(corpus, queries, bm25.build(corpus)).where("query_id IS NOT NULL").collect()}
    for q, text in asked[:5]:
        for i, s in enumerate(reference_bm25(texts, text)):
            assert got.get((q, f"d{i:03}"), 0.0) == pytest.approx(s, abs=1e-6)


def test_scores_shuffle_texts_only(spark, collection):
    corpus, _, queries, _ = collection
    plan = bm25.scores(corpus, queries, bm25.build(corpus))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_scores_of_repeated_rows(spark):
    # "a" has two texts, one of them twice in the same place; "b" two of one place but different lengths.
    rows = [("a", "x y y", 0), ("a", "x y y", 0), ("a", "x z", 1), ("b", "y", 2), ("b", "x x w", 2), ("c", "v", 3), (None, "y z", 4), (None, "y", 5), ("d", None, 6), ("e", "u u", 7)]
    corpus = spark.createDataFrame(rows, "doc_id string, text_norm string, corpus_ord long").repartition(3)
    queries = spark.createDataFrame([("q", "X y"), ("q", "y v"), ("r", "unseen"), ("s", None), (None, "x")], "query_id string, query_norm string")
    index = bm25.build(corpus)
    idf = {r.term: r.idf for r in index.terms.collect()}
    part = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / index.avgdl))
    want = {
        ("q", "a"): idf["x"] * (part(2, 3) + part(1, 2)) + 2 * idf["y"] * part(4, 3),
        ("q", "b"): idf["x"] * part(2, 3) + 2 * idf["y"] * part(1, 1),
        ("q", "c"): idf["v"] * part(1, 1),
        ("q", None): 2 * idf["y"] * (part(1, 2) + part(1, 1)),
    }
    got = bm25.scores(corpus, queries, index).collect()
    assert len(got) == len(want) and {(r.query_id, r.doc_id): r.score for r in got} == pytest.approx(want, abs=1e-6)


def test_scores_in_small_blocks(spark, collection, monkeypatch):
    corpus, _, queries, _ = collection
    index = bm25.build(corpus)
    want = sorted(map(tuple, bm25.scores(corpus, queries, index).collect()))
    assert len(want) == len({x[:2] for x in want}) > 60
    monkeypatch.setattr(bm25, "QUERY_TERMS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert sorted(map(tuple, bm25.scores(corpus, queries, index).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    block = bm25.QueryBlock([("q1", "x", 1, 1.0), ("q2", "y", 1, -1.0), ("q2", "x", 1, 1.0), ("q3", "z", 1, 1.0)])
    monkeypatch.setattr(bm25, "DOCS_AT_ONCE", 2)
    monkeypatch.setattr(bm25, "PAIRS_AT_ONCE", 2)
    rows = pa.record_batch([["a", "b", "c"], [0, 1, 2], ["x y", "y", "w"]], names=["doc_id", "o", "t"])
    out = [b.to_pylist() for b in bm25._pair_scorer(SimpleNamespace(value=block), 6, 1.2, 0.75, 1.0)(iter([rows]))]
    a, b = round(2.2 / (1 + 1.2 * (0.25 + 0.75 * 2)), 6), -1.0
    # Terms that cancel each other are shared all the same.
    assert [(r["query_id"], r["doc_id"], r["score"]) for x in out for r in x] == [("q1", "a", a), ("q2", "a", 0.0), ("q2", "b", b)]


def test_negative_floor_ranks_below_zero(spark):
    corpus = spark.createDataFrame([("a", "x y", 0), ("b", "x y", 1), ("c", "z", 2)], "doc_id string, text_norm string, corpus_ord long")
    queries = spark.createDataFrame([("q", "x")], "query_id string, query_norm string")
    want = sorted(zip([-s for s in reference_bm25(["x y", "x y", "z"], "x")], [0, 1, 2]))
    assert [r.doc_id for r in bm25.search(corpus, queries, bm25.build(corpus), 3).orderBy("rank").collect()] == ["abc"[i] for _, i in want]


def test_search_of_nothing(spark, collection):
    corpus, _, queries, _ = collection
    index = bm25.build(corpus)
    assert bm25.search(corpus.limit(0), queries, index).count() == 0
    assert bm25.search(corpus, queries.limit(0), index).count() == 0
    assert bm25.build(corpus.limit(0)).n_docs == 0


def test_dense_equals_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(90)] + [(999, None)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in dense.search(df, df.where("vec_id % 30 = 0"), 5, "vec_id", "vec_id").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    full = np.round(v.astype(float) @ v.astype(float).T, 6)
    assert {q: [d for _, d in sorted(x)] for q, x in got.items()} == {q: sorted(range(90), key=lambda i: (-full[q, i], i))[:5] for q in (0, 30, 60)}


def test_encoder_and_normalisation(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string").select(dense.encoder(lambda ts: np.array([[len(t), 1.0] for t in ts]))("t").alias("v"))
    assert [r.v for r in df.collect()] == [[2.0, 1.0], [0.0, 1.0]]
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(dense.l2_normalize(F.col("v")).alias("v")).collect()
    assert unit[0].v == pytest.approx([0.6, 0.8]) and unit[1].v == [0.0, 0.0]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_dense_over_many_batches(spark, kind):
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, (400, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "n long, embedding array<double>").select(F.col("n").cast(kind).alias("id"), "embedding").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = dense.search(df, df.where("CAST(id AS INT) % 50 = 0"), 6, "id", "id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    full = np.round(v @ v.T, 6)
    key = (lambda i: i) if kind == "long" else str
    want = {(key(q), n + 1): key(d) for q in range(0, 400, 50) for n, d in enumerate(sorted(range(400), key=lambda i: (-full[q, i], key(i)))[:6])}
    assert {(r.query_id, r["rank"]): r.doc_id for r in rows} == want


def test_search_over_many_batches(spark, collection):
    corpus, _, queries, _ = collection
    index = bm25.build(corpus)
    want = {(r.query_id, r["rank"]): r.doc_id for r in bm25.search(corpus, queries, index, 9).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert {(r.query_id, r["rank"]): r.doc_id for r in bm25.search(corpus, queries, index, 9).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_hybrid_of_both_searches(spark):
    corpus = spark.createDataFrame([("a", "aspirin reduces pain", 0), ("b", "unrelated words", 1), ("c", None, 2), ("d", "pain", 3)], "doc_id string, text_norm string, corpus_ord long")
    queries = spark.createDataFrame([("q", "Aspirin pain"), ("n", None), (None, "pain")], "query_id string, query_raw string")
    rows = hybrid.search(corpus, queries, bm25.build(corpus), k=3).collect()
    assert {r.query_id for r in rows} == {"q", "n"} and next(r.doc_id for r in rows if r.query_id == "q" and r["rank"] == 1) == "a"
    v = np.array(spark.createDataFrame([("ab ab c",), ("",)], "t string").select(hybrid.hashed_terms(F.col("t")).alias("v")).collect()[0].v)
    assert np.linalg.norm(v) == pytest.approx(1) and sorted(v[v > 0].round(4).tolist()) == [0.4472, 0.8944]


def run_of(spark, docs, q="q"):
    return spark.createDataFrame([(q, d, i + 1) for i, d in enumerate(docs)], "query_id string, doc_id string, rank int")


def test_fusion(spark):
    got = runs.reciprocal_rank_fusion([run_of(spark, "abc"), run_of(spark, "bda")], 60, 10).orderBy("rank").collect()
    assert got[0].doc_id == "b" and {r.doc_id: r.rrf for r in got} == pytest.approx({"a": 1 / 61 + 1 / 63, "b": 1 / 62 + 1 / 61, "c": 1 / 63, "d": 1 / 62})
    tie = runs.reciprocal_rank_fusion([run_of(spark, "xy"), run_of(spark, "yx")], 60, 10).orderBy("rank").collect()
    assert [r.doc_id for r in tie] == ["x", "y"]
    assert runs.reciprocal_rank_fusion([run_of(spark, "abcdefgh"), run_of(spark, "ijklmnop")], 60, 5).count() == 5
    assert [r.doc_id for r in runs.reciprocal_rank_fusion([run_of(spark, "cab")], 60, 5).orderBy("rank").collect()] == list("cab")
    assert runs.reciprocal_rank_fusion([run_of(spark, "a").limit(0), run_of(spark, "b").limit(0)]).count() == 0


def test_pack_and_unpack(spark):
    run = run_of(spark, "cab")
    packed = runs.pack(run)
    assert packed.first().docs == ["c", "a", "b"]
    assert {(r.doc_id, r["rank"]) for r in runs.unpack(packed, "s").collect()} == {("c", 1), ("a", 2), ("b", 3)}


def test_run_of_stage(spark):
    rows = [("q", "a", 2, "s", 1.0), ("q", "a", 1, "s", 3.0), ("q", "b", None, "s", 3.0), ("q", "c", 1, "s", float("nan")), ("q", "d", 1, "s", None), (None, "a", 1, "s", 9.0), ("q", "e", 1, "t", 9.0)]
    got = runs.run_of_stage(spark.createDataFrame(rows, "query_id string, doc_id string, rank int, stage string, score double"), "s").orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [("a", 3.0), ("b", 3.0)]


def test_whole_runs_are_kept(spark, sf_dir):
    rows = [("hot", f"d{i:03}", i % 7 or None, "s", float(i // 9)) for i in range(450)] + [("cold", "a", 1, "s", 1.0)]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, rank int, stage string, score double").repartition(4)
    want = [r[1] for r in sorted(rows[:450], key=lambda r: (-r[4], r[2] is None, r[2] or 0, r[1]))]
    assert {r.query_id: r.docs for r in runs.pack(runs.run_of_stage(df, "s")).collect()} == {"hot": want, "cold": ["a"]}
    assert [r.doc_id for r in runs.run_of_stage(df, "s", 20).where("query_id = 'hot'").orderBy("rank").collect()] == want[:20]
    sf = sf_dir.replace("0.001", "0.01")
    valid = {(r.query_id, r.doc_id) for r in load(spark, sf, "runs").where("stage = 'hybrid' AND score IS NOT NULL AND NOT isnan(score)").collect() if r.query_id is not None and r.doc_id is not None}
    got = [(r.query_id, r.doc_id) for r in catalogue.queries()["unpacked_runs"](spark, sf).collect()]
    assert len(got) == len(valid) and set(got) == valid


CLEAN = [
    ("<i>a</i> &amp; $k_1$ \\textbf{x} b", "a & b"),
    ("p &lt; 0.05 and q &gt; 3", "p 3"),
    ("costs $5 and $10", "costs 10"),
    ("１ﬁ x\u001cy", "1fi x y"),
    (None, ""),
    ("  \t\n ", ""),
]


def test_cleaning(spark):
    df = spark.createDataFrame([(str(i), None, t, i) for i, (t, _) in enumerate(CLEAN)], "doc_id string, title string, abstract string, corpus_ord long")
    got = {r.doc_id: r.text_raw for r in prep.clean_corpus(df).collect()}
    assert got == {str(i): w for i, (_, w) in enumerate(CLEAN)}


def test_preparation_keeps_first_and_drops_orphans(spark):
    raw = spark.createDataFrame([("b", "T", "x  y", 0), ("a", "t", "X y", 1), ("c", None, None, 2), ("d", "IL-6 rise", "", 3)], "doc_id string, title string, abstract string, corpus_ord long")
    corpus = prep.prepare_corpus(raw)
    assert {(r.doc_id, r.n_tokens, r.has_abbrev) for r in corpus.collect()} == {("b", 3, False), ("c", 0, False), ("d", 2, True)}
    qrels = spark.createDataFrame([("q1", "a", 1.0), ("q2", "b", 0.0), ("q2", "d", 2.0)], "query_id string, doc_id string, relevance double")
    queries = spark.createDataFrame([("q1", "One"), ("q2", None), ("q3", "x")], "query_id string, query_text string")
    assert {(r.query_id, r.query_norm) for r in prep.prepare_queries(queries, qrels).collect()} == {("q1", "one"), ("q2", "")}
    assert {(r.query_id, r.doc_id) for r in prep.prepare_qrels(qrels, corpus).collect()} == {("q2", "b"), ("q2", "d")}
    assert prep.queries_with_several_judgments(qrels).first().n_multi == 1
    counters = prep.prep_counters(raw, corpus).first()
    assert (counters.n_raw, counters.n_kept, counters.n_removed, counters.n_empty_abstract) == (4, 3, 1, 2)
    lengths = prep.length_summary(spark.createDataFrame([(i,) for i in range(1, 6)], "n_tokens int"), 4).first()
    assert (lengths["mean"], lengths["median"], lengths["p95"], lengths["pct_over"]) == (3.0, 3.0, pytest.approx(4.8), 20.0)


def test_ambiguous_abbreviations(spark):
    texts = ["interleukin (IL) and IL-inhibitor", "IL, heart", "kidney IL.", "DNA only", None]
    got = prep.ambiguous_abbreviations(spark.createDataFrame([(t,) for t in texts], "text_raw string")).collect()
    assert [(r.abbreviation, r.n_occurrences, r.n_distinct_nearby_words, r.sample_nearby_words) for r in got] == [("IL", 4, 3, ["inhibitor", "interleukin", "kidney"])]
