import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill.functions import text as X
from rankmill.operators import analysis, metrics, rerank, significance
from rankmill.operators.storage import load
from rankmill.plans import catalogue, pipelines
from rankmill.sources import io
from rankmill.streaming.search import search_stream
from rankmill.utils import runtime

RUN = "query_id string, doc_id string, rank int"
QRELS = "query_id string, doc_id string, relevance double"


def run(spark, rankings):
    return spark.createDataFrame([(q, d, i + 1) for q, docs in rankings.items() for i, d in enumerate(docs)], RUN)


def judged(spark, grades):
    return spark.createDataFrame([(q, d, float(g)) for q, ds in grades.items() for d, g in ds.items()], QRELS)


def by_hand(docs, rel, k):
    good = {d for d, g in rel.items() if g > 0}
    dcg = sum(rel.get(d, 0) / math.log2(i + 2) for i, d in enumerate(docs[:k]))
    ideal = sum(g / math.log2(i + 2) for i, g in enumerate(sorted((g for g in rel.values() if g > 0), reverse=True)[:k]))
    first = next((i + 1 for i, d in enumerate(docs) if d in good), None)
    hits = sum(d in good for d in docs[:k])
    return (hits / k, min(len(good), k) / k, hits / len(good) if good else 0.0, 1 / first if first else 0.0, dcg / ideal if ideal else 0.0)


@pytest.mark.parametrize("k", [1, 5, 10])
def test_metrics_match_hand_computation(spark, k):
    rng = random.Random(42)
    rankings, grades = {}, {}
    for q in range(40):
        docs = [f"d{i}" for i in rng.sample(range(200), 30)]
        grades[f"q{q}"] = {rng.choice(docs) if rng.random() < 0.75 else f"d{rng.randrange(200)}": rng.choice([1, 1, 2, 0, -1]) for _ in range(rng.choice([1, 1, 2, 3]))}
        rankings[f"q{q}"] = docs
    got = {r[0]: tuple(r)[1:] for r in metrics.evaluate(run(spark, rankings), judged(spark, grades), k, skip_unjudged=False).collect()}
    assert len(got) == 40
    for q in rankings:
        assert got[q] == pytest.approx(by_hand(rankings[q], grades[q], k), abs=1e-9)


def test_metric_edges(spark):
    r, q = run(spark, {"q1": ["d1", "d2", "d1"], "q3": ["d9"]}), judged(spark, {"q1": {"d1": 1}, "q2": {"d1": 1}, "q4": {"x": 1}})
    asked = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query_id string")
    got = {x.query_id: x for x in metrics.evaluate(r, q, 5, asked).collect()}
    assert set(got) == {"q1", "q2"}  # q3 has no judgment, q4 isn't in the run
    assert got["q1"].precision == 0.4 and got["q2"].ndcg == 0.0 == got["q2"].mrr
    with pytest.raises(ValueError):
        metrics.evaluate(r, q, 0)
    empty = metrics.aggregate(metrics.evaluate(r.limit(0), q)).first()
    assert empty.n_queries == 0 and empty.mrr is None


def test_aggregate_is_a_ratio_of_means(spark):
    row = metrics.aggregate(metrics.evaluate(run(spark, {"q1": list("abcde"), "q2": list("bacde")}), judged(spark, {"q1": {"a": 1}, "q2": {"a": 1}}))).first()
    assert (row.precision, row.precision_ceiling, row.precision_pct_of_ceiling, row.n_queries) == pytest.approx((0.2, 0.2, 1.0, 2))


def test_recall_ceiling_rises(spark):
    rng = random.Random(3)
    rankings = {f"q{i}": [f"d{j}" for j in rng.sample(range(100), 100)] for i in range(30)}
    rows = metrics.recall_ceiling(run(spark, rankings), judged(spark, {q: {"d1": 1, "d2": 2, "d3": 0} for q in rankings})).orderBy("k").collect()
    values = [r.recall for r in rows]
    assert values == sorted(values) and values[-1] == 1.0 and rows[-1].pct_queries_with_hit == 100.0 and [r.k for r in rows] == [5, 10, 20, 50, 100]


def test_comparison(spark):
    pairs = spark.createDataFrame([("a", 0.1, 0.5), ("b", 0.5, 0.1), ("c", 0.3, 0.3)], "query_id string, stage1 double, stage2 double").withColumn("delta", F.col("stage2") - F.col("stage1"))
    row = metrics.compare(pairs).first()
    assert (row.n_improved, row.n_degraded, row.n_unchanged) == (1, 1, 1)
    with pytest.raises(Exception, match="share no query"):
        metrics.compare(pairs.limit(0)).collect()


def wilcoxon_by_hand(deltas):
    d = [x for x in deltas if x]
    ranks = [sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2 for x in d]
    plus, minus, n = sum(r for r, x in zip(ranks, d) if x > 0), sum(r for r, x in zip(ranks, d) if x < 0), len(d)
    if not n:
        return 0, 0.0, 0.0, 1.0
    z = (plus - n * (n + 1) / 4 - (0.5 if plus > n * (n + 1) / 4 else -0.5)) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return n, min(plus, minus), z, significance.normal_p(z)


@pytest.mark.parametrize("deltas", [[0.0, 0.0], [random.Random(7).gauss(0.05, 0.2) for _ in range(150)], [0.1, -0.1, 0.2, 0.2, -0.3, 0.0, 0.5, 0.1], [0.1 * i for i in range(1, 11)], [1.0, -2.0, -3.0, 4.0]])
def test_wilcoxon(spark, deltas):
    row = significance.wilcoxon(spark.createDataFrame([(x,) for x in deltas], "delta double")).first()
    assert (row.n_nonzero, row.w_stat, row.z, row.p_value) == pytest.approx(wilcoxon_by_hand(deltas))


def test_bootstrap(spark):
    rng = random.Random(3)
    deltas = [rng.gauss(0.03, 0.1) for _ in range(300)]
    df = spark.createDataFrame([(f"q{i:03}", i, x) for i, x in enumerate(deltas)], "query_id string, row long, delta double").repartition(3)
    a, b = significance.bootstrap_replay(df, 2000).first(), significance.bootstrap_replay(df, 2000).first()
    mean = sum(deltas) / 300
    assert a == b and a.ci_lower < mean < a.ci_upper and a.n_queries == 300 and a.observed_mean_delta == pytest.approx(mean)
    r = random.Random(42)
    means = sorted(sum([deltas[r.randrange(300)] for _ in range(300)]) / 300 for _ in range(2000))
    assert (a.ci_lower, a.ci_upper) == (means[50], means[1949])
    h = significance.bootstrap_hash(df, 2000).first()
    assert h.ci_lower == pytest.approx(a.ci_lower, abs=0.003) and h.ci_upper == pytest.approx(a.ci_upper, abs=0.003)


def test_a_bootstrap_of_nothing_fails(spark):
    none = spark.createDataFrame([("q", 1, None)], "query_id string, row long, delta double")
    for run_ in (significance.bootstrap_replay, significance.bootstrap_hash):
        with pytest.raises(Exception, match="needs a delta"):
            run_(none, 10).collect()


@pytest.mark.parametrize("n,seed", [(1, 42), (2, 1), (300, 42), (256, 7), (1000, 42)])
def test_replayed_draws(n, seed):
    rng, draws = random.Random(seed), significance.replayed_draws(n, seed)
    for _ in range(50):
        assert next(draws).tolist() == [rng.randrange(n) for _ in range(n)]


def test_registered_bootstraps_resample_10000_times(spark, sf_dir):
    deltas = [(r.query_id, r.delta) for r in catalogue._pairs(spark, sf_dir).collect()]
    d, n, rng = [x for _, x in sorted(deltas)], len(deltas), random.Random(42)
    means = sorted(sum([d[rng.randrange(n)] for _ in range(n)]) / n for _ in range(10_000))
    got = catalogue.queries()["bootstrap_replay_ci"](spark, sf_dir).first()
    assert (got.n_samples, got.ci_lower, got.ci_upper) == (10_000, means[250], means[9749])
    rows = np.array([int(q[1:]) for q, _ in deltas]) % significance.PRIME
    w = significance.poisson_weight(np.arange(10_000)[:, None], rows[None, :], 42)
    m = np.sort(w @ np.array([x for _, x in deltas]) / w.sum(axis=1))
    h = catalogue.queries()["bootstrap_hash_ci"](spark, sf_dir).first()
    assert (h.ci_lower, h.ci_upper) == pytest.approx((m[250], m[9749]), abs=2e-9)


def corpus_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, title string, text_raw string, n_tokens int")


def queries_of(spark, rows):
    return spark.createDataFrame(rows, "query_id string, query_raw string")


def test_rank_deltas(spark):
    got = analysis.rank_deltas(run(spark, {"q": ["a", "b", "c", "e"]}), run(spark, {"q": ["c", "a", "b"]}), judged(spark, {"q": {"c": 1, "a": 0}}), queries_of(spark, [("q", "text")]), corpus_of(spark, [("c", "C", "x", 900)]))
    rows = {r.doc_id: r for r in got.collect()}
    c = rows["c"]
    assert (c.rank_stage1, c.rank_ce, c.delta, c.is_relevant, c.was_truncated, c.doc_title) == (3, 1, 2, True, True, "C")
    assert rows["e"].delta is None and rows["e"].rank_ce is None and rows["a"].doc_title == "" and not rows["a"].is_relevant


def test_cases_are_of_different_queries(spark):
    one = {"q1": [*"abcdefghi", "r"], "q2": [*"abcdef"], "q3": [*"abcdef"], "q4": [*"rabcde"], "q5": [*"abcdefg"], "q6": [*"abcd"]}
    two = {"q1": ["r", *"abcdefghi"], "q2": [*"cdefab"], "q3": [*"bacdef"], "q4": [*"abcder"], "q5": [*"gfedcba"], "q6": [*"dbca"]}
    q = judged(spark, {"q1": {"r": 1}, "q4": {"r": 1}})
    queries = queries_of(spark, [("q1", "IL"), ("q2", "x"), ("q3", "y"), ("q4", "z"), ("q5", "the TCR"), ("q6", "an NK cell")])
    a, b = run(spark, one), run(spark, two)
    deltas = analysis.rank_deltas(a, b, q, queries, corpus_of(spark, [("a", "t", "x", 1)]))
    cases = {r.case: r.query_id for r in analysis.select_cases(deltas, analysis.ndcg_deltas(a, b, q), queries).collect()}
    assert cases["relevant_promoted"] == "q1" and cases["failure"] == "q4" and cases["minimal_change"] == "q3" and len(set(cases.values())) == len(cases) == 5
    assert analysis.case_evidence(deltas, analysis.select_cases(deltas, analysis.ndcg_deltas(a, b, q), queries), 2).count() == 10


def test_failure_causes(spark):
    corpus = corpus_of(spark, [("long", "", "w " * 600, 600), ("neg", "", "The study found no effect of aspirin on platelet aggregation.", 10), ("ok", "", "fine", 1)])
    queries = queries_of(spark, [("q1", "plain words"), ("q2", "TCR signaling requires CD8."), ("q3", "aspirin reduces platelet aggregation"), ("q4", "nothing here")])
    first = run(spark, {"q1": ["long"], "q2": ["ok"], "q3": ["neg", "ok"], "q4": ["ok"]})
    deltas = analysis.rank_deltas(first, first, judged(spark, {"q1": {"long": 1}, "q2": {"ok": 1}, "q3": {"ok": 1}, "q4": {"ok": 1}}), queries, corpus)
    got = {r.query_id: r for r in analysis.classify_failures(queries.select("query_id"), deltas, queries, corpus).collect()}
    assert got["q1"].causes == "long_document_truncation" and got["q2"].causes == "abbreviation_ambiguity" and got["q3"].causes == "negation_context_misreading"
    assert got["q4"].causes.startswith("topic_or_entity_mismatch") and got["q4"].n_automated_causes == 0 and "TCR" in got["q2"].evidence and "aspirin" in got["q3"].evidence
    counts = analysis.cause_histogram(analysis.classify_failures(queries.select("query_id"), deltas, queries, corpus))
    assert sum(r["count"] for r in counts.collect()) == 4
    assert analysis.truncated_relevant(deltas).first()[0] == 1


def negation_by_hand(query, doc, reach=60):
    """A character at a time: every place at which a cue begins, in order of cues."""
    wanted, low = set(re.findall("[a-z]{4,}", (query or "").lower())), (doc or "").lower()
    for cue in X.NEGATION_CUES:
        for at in range(len(low)):
            if low.startswith(cue, at):
                hit = wanted & set(re.findall("[a-z]{4,}", low[max(0, at - reach) : at + len(cue) + reach]))
                if hit:
                    return cue, sorted(hit)
    return None


def test_negation_windows(spark):
    rng = random.Random(17)
    words = ["platelet", "aspirin", "casino", "floor", "no", "not", "did not", "without", "effect", "x" * 30, "unable to", "\n", "of"]
    pairs = [("casino tables", "the casino floor has tables"), ("platelet", "not " + "x" * 70 + " platelet"), ("platelet", "platelet" + "y" * 52 + "not "), (None, None), ("aspirin", None), ("", "no aspirin")]
    pairs += [(" ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=rng.randrange(25)))) for _ in range(300)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, q string, d string")
    got = {r.i: r.n and (r.n.cue, r.n.words) for r in df.select("i", X.negation(F.col("q"), F.col("d")).alias("n")).collect()}
    assert [got[i] for i in range(len(pairs))] == [negation_by_hand(*p) for p in pairs] and got[0] == ("no ", ["casino", "tables"])


def nearby_by_hand(text, reach=30):
    out = []
    for m in re.finditer(r"(?<!\w)[A-Z]{2,6}(?!\w)", text or ""):
        after = re.match(r"[-( ]*\s*([a-zA-Z][a-zA-Z-]{3,})", text[m.end() : m.end() + reach])
        before = re.findall(r"[a-zA-Z][a-zA-Z-]{3,}", text[max(0, m.start() - reach) : m.start()])
        out.append((m[0], after[1].lower() if after else before[-1].lower() if before else None))
    return out


def test_abbreviation_contexts(spark):
    rng = random.Random(18)
    parts = ["IL", "TNF", "interleukin", "(IL)", "IL-6", "HIV-infected", "and", "a", "\n", "  ", "é", "x" * 29, "- (", "Toolongword", "ABCDEFG", "NK"]
    texts = [None, "", "IL"] + ["".join(rng.choice([" ", "", " "]) + rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").where("t IS NOT NULL")
    got = {r.i: [tuple(x) for x in r.c] for r in df.select("i", X.abbreviation_contexts(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        if t is not None:
            assert got[i] == nearby_by_hand(t), t


def test_mining(spark):
    qrels, queries, corpus = judged(spark, {"q": {"r": 1, "s": 1}}), queries_of(spark, [("q", "text"), ("u", "free")]), corpus_of(spark, [("r", "R", "", 1)])
    dense_run, lexical = run(spark, {"q": list("rxsyz"), "u": ["v"]}), run(spark, {"q": [f"p{i}" for i in range(15)] + ["s"]})
    got = analysis.lexical_mismatch(lexical, dense_run, qrels, queries, corpus).collect()
    assert [(r.doc_id, r.bm25_rank, r.dense_rank) for r in got] == [("r", "not in top-100", 1), ("s", "16", 3)]
    assert {(r.query_id, r.doc_id) for r in analysis.semantic_drift(dense_run, qrels, queries, corpus).collect()} == {("q", "x"), ("u", "v")}


def test_reranking(spark):
    corpus = corpus_of(spark, [("a", "", "unrelated text", 2), ("b", "", "aspirin platelet study", 3), ("c", "", "word " * 600, 600), ("d", "", None, 0)])
    queries, pool = queries_of(spark, [("q", "Aspirin and platelet")]), run(spark, {"q": ["a", "c", "b", "d", "gone"]})
    scorer = rerank.OverlapScorer()
    rows = rerank.rerank(pool, queries, corpus, scorer).orderBy("rank").collect()
    assert rows[0].doc_id == "b" and len(rows) == 4 and {r.doc_id for r in rows if r.was_truncated} == {"c"}
    assert [r.doc_id for r in rerank.rerank(pool, queries, corpus, scorer, 20, 1).collect()] == ["b"]
    scored = rerank.score_pool(pool, queries, corpus, scorer)
    assert rerank.truncation_rate(scored).first().truncation_pct == 25.0 and rerank.truncation_rate(scored.limit(0)).first().truncation_pct == 0.0
    trace = rerank.pair_trace(pool, queries, corpus, scorer).first()
    assert trace.tokens[0] == "[CLS]" and trace.tokens[-1] == "[SEP]" and len(trace.tokens) == trace.n_tokens_before_truncation == 8
    model = rerank.ModelScorer("length", lambda: lambda pairs: ([len(t) for _, t in pairs], [len(q.split()) + len(t.split()) for q, t in pairs]))
    assert [r.doc_id for r in rerank.rerank(pool, queries, corpus, model).orderBy("rank").collect()] == ["c", "b", "a", "d"]
    grid = rerank.grid({"overlap": scored}, judged(spark, {"q": {"b": 1}}), queries, (1, 3)).orderBy("k").collect()
    assert [(r.k, r.ndcg) for r in grid] == [(1, 0.0), (3, 1.0)]

    def broken():
        raise OSError

    assert rerank.resolve_scorer(broken, lambda: scorer) is scorer and rerank.resolve_scorer(lambda: model, broken) is model


VOCABULARY = os.path.join(os.environ.get("RANKMILL_TOKENIZERS", "/opt/tokenizers"), "word_bpe_49k.json")


def test_model_trace(spark):
    tokenizers = pytest.importorskip("tokenizers")
    corpus = corpus_of(spark, [("a", "", "Aspirin inhibits platelets.", 3), ("b", "", "word " * 900, 900), ("c", "", None, 0)])
    queries, pool = queries_of(spark, [("q1", "Aspirin?"), ("q2", "long " * 300), ("q3", "x")]), run(spark, {"q1": ["a"], "q2": ["b"], "q3": ["c"]})
    got = {r.query_id: r for r in rerank.model_trace(pool, queries, corpus, rerank.OverlapScorer(), VOCABULARY).collect()}
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    q, d = (t.encode(x, add_special_tokens=False).ids for x in ("Aspirin?", "Aspirin inhibits platelets."))
    assert got["q1"].input_ids == [49406, *q, 49407, *d, 49407] and not got["q1"].was_truncated and len(got["q1"].tokens) == len(got["q1"].input_ids)
    assert len(got["q2"].input_ids) == 512 and got["q2"].was_truncated and got["q2"].n_tokens_before_truncation == 1203
    assert got["q2"].input_ids.index(49407) == 256 and len(got["q3"].input_ids) == 4


@pytest.mark.parametrize("a,b,room", [(3, 4, 9), (10, 3, 9), (3, 10, 9), (10, 10, 9), (10, 9, 9), (9, 10, 9), (0, 20, 9), (20, 0, 9), (5, 4, 9), (5, 5, 9)])
def test_the_longer_gives_way(a, b, room):
    x, y = a, b
    while x + y > room:
        x, y = (x - 1, y) if x > y else (x, y - 1)
    got = rerank._longest_first(a, b, room)
    assert got == (x, y)


def test_timed_grid_and_gap(spark):
    corpus = corpus_of(spark, [("a", "", "aspirin " + "word " * 9 + "other text here", 12), ("b", "", "aspirin", 1), ("c", "", "nothing", 1)])
    queries, pool = queries_of(spark, [("q", "aspirin study")]), run(spark, {"q": ["c", "a", "b"]})
    rows = rerank.timed_grid({"one": rerank.OverlapScorer(), "two": rerank.DensityScorer()}, pool, queries, corpus, judged(spark, {"q": {"b": 1}}), (1, 3), warmup=1, repeats=2)
    got = {(r.model, r.k): r for r in rows.collect()}
    assert set(got) == {(m, k) for m in ("one", "two") for k in (1, 3)} and got["two", 3].model_name == "density" and got["two", 3].ndcg == 1.0 and all(0 < r.latency_p50_ms <= r.latency_p95_ms for r in got.values())
    gap = analysis.grid_gap(rows.select("model", "k", "ndcg"), "two", "one").first()
    assert (gap.k_min, gap.k_max, gap.gap_at_min, gap.widens) == (1, 3, 0.0, gap.gap_at_max > 0)


def test_reciprocal_rank_with_a_cut(spark):
    r, q = run(spark, {"q1": ["a", "b", "c"], "q2": ["c"]}), judged(spark, {"q1": {"c": 1}, "q2": {"c": 1}})
    assert {x.query_id: x.mrr for x in metrics.evaluate(r, q, mrr_at=2).collect()} == {"q1": 0.0, "q2": 1.0}
    assert {x.query_id: x.mrr for x in metrics.evaluate(r, q).collect()} == {"q1": pytest.approx(1 / 3), "q2": 1.0}


# The non-zero differences in nDCG@5 of a published comparison over 300 queries, and how often each occurs.
PUBLISHED = {
    0.36907024642854247: 11, -0.36907024642854247: 11, -0.5: 9, -0.13092975357145753: 6, 0.5: 5, 1.0: 4, 0.43067655807339306: 3, -0.6309297535714575: 3, -0.08027921085181244: 3,
    -0.5693234419266069: 3, -1.0: 3, 0.13092975357145753: 2, -0.20025319549806447: 2, 0.5693234419266069: 2, -0.38685280723454163: 2, 0.14965509446524541: 2, 0.38685280723454163: 2,
    0.3490790701928675: 1, 0.04382375083885143: 1, 0.0325320165108306: 1, -0.16958010263680812: 1, 0.07284476575819265: 1, 0.6309297535714575: 1, -0.07817485246961253: 1,
    -0.43067655807339306: 1, 0.22629438553091674: 1, -0.34907907019286744: 1, -0.3065735963827292: 1, 0.2440769463369159: 1, 0.1815417925373526: 1, -0.6509209298071326: 1, 0.44149241373678083: 1,
}


def test_published_significance(spark):
    deltas = [x for x, n in PUBLISHED.items() for _ in range(n)]
    deltas += [0.0] * (300 - len(deltas))
    df = spark.createDataFrame([(x,) for x in deltas], "delta double")
    row = significance.wilcoxon(df).first()
    assert (row.n_nonzero, row.w_stat) == (88, 1775.0) and (row.z, row.p_value) == pytest.approx((-0.7593561543, 0.4476395345), abs=1e-9)
    pairs = df.withColumn("query_id", F.monotonically_increasing_id()).withColumn("stage1", F.lit(0.0)).withColumn("stage2", F.col("delta"))
    c = metrics.compare(pairs).first()
    assert (c.n_improved, c.n_degraded, c.n_unchanged) == (40, 48, 212) and c.mean_delta == pytest.approx(-0.0093274203, abs=1e-10)


def test_pipeline(spark, sf_dir):
    raw = load(spark, sf_dir, "corpus").select("doc_id", "title", F.col("text_raw").alias("abstract"), "corpus_ord")
    p = pipelines.prepare(raw, load(spark, sf_dir, "queries").select("query_id", F.col("query_raw").alias("query_text")), load(spark, sf_dir, "qrels"), with_title=False)
    stage = pipelines.first_stage(p, catalogue._stage(spark, sf_dir, "dense"))
    reranked = pipelines.second_stage(p, stage["hybrid"], rerank.OverlapScorer())
    out = pipelines.evaluate_stages(p, stage["hybrid"], reranked)
    assert out["metrics"].count() == 2 and out["comparison"].first().n_queries > 0 and 0 <= out["wilcoxon"].first().p_value <= 1 and out["bootstrap"].count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id": "7", "title": "T", "text": "x"}\n{"_id": "8", "text": null}\n')
    (tmp_path / "q.jsonl").write_text('{"_id": "1", "text": "x"}\n')
    (tmp_path / "r.tsv").write_text("query-id\tcorpus-id\tscore\n1\t7\t1\n")
    corpus, queries, qrels = io.read_collection(spark, *(str(tmp_path / n) for n in ("c.jsonl", "q.jsonl", "r.tsv")))
    assert [(r.doc_id, r.title) for r in corpus.orderBy("corpus_ord").collect()] == [("7", "T"), ("8", None)] and qrels.first().relevance == 1.0
    io.write_prepared(f"{tmp_path}/p", corpus, queries, qrels)
    assert [t.count() for t in io.read_prepared(spark, f"{tmp_path}/p")] == [2, 1, 1]
    scored = run(spark, {"q": ["a", "b"]}).withColumn("score", F.lit(1.0))
    io.write_run(scored, "bm25", f"{tmp_path}/runs")
    io.write_run(scored.limit(1), "dense", f"{tmp_path}/runs")
    assert io.read_run(spark, "bm25", f"{tmp_path}/runs").count() == 2
    io.write_table(scored, f"{tmp_path}/csv")
    assert io.read_table(spark, f"{tmp_path}/csv", scored.schema).first().query_id == "q"
    io.write_object(scored.limit(1), f"{tmp_path}/o.json")
    assert '"doc_id": "a"' in (tmp_path / "o.json").read_text()
    io.append_manifest(f"{tmp_path}/m.jsonl", runtime.run_description(spark, "one", seed=42))
    (tmp_path / "m.jsonl").open("a").write("broken\n")
    io.append_manifest(f"{tmp_path}/m.jsonl", {"run_label": "two"})
    assert [m["run_label"] for m in io.read_manifest(f"{tmp_path}/m.jsonl")] == ["one", "two"]


def test_order_of_many_files(spark, tmp_path):
    """Names, sizes and splits in no order: rows are numbered by file name and line all the same."""
    (tmp_path / "in").mkdir()
    rng, want = random.Random(19), []
    for name in sorted(f"part-{i:02}" for i in range(12)):
        lines = [f"{name}:{i}" for i in range(rng.choice([1, 3, 400]))]
        want += lines
        (tmp_path / "in" / f"{name}.jsonl").write_text("".join(f'{{"_id": "{x}", "title": "{"t" * 40}"}}\n' for x in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            corpus = io.in_file_order(spark.read.schema("_id string, title string").json(f"{tmp_path}/in"), "o")
            assert [r["_id"] for r in corpus.orderBy("o").collect()] == want and corpus.select("o").distinct().count() == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_printed_tables_and_charts(spark, tmp_path):
    df = spark.createDataFrame([("bm25", 5, 0.72181), ("x", 10, None)], "method string, k int, recall double")
    assert io.table_text(df) == "method   k  recall\nbm25     5  0.7218\nx       10       -"
    with pytest.raises(ValueError):
        io.table_text(spark.range(101))
    with pytest.raises(ValueError):
        io.plot_lines(spark.range(io.CHART_POINTS + 1).selectExpr("id AS x", "id AS y", "'s' AS s"), "x", "y", "s", f"{tmp_path}/c.png") or pytest.skip("no matplotlib")


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from rankmill.operators import bm25

    corpus, queries = load(spark, sf_dir, "corpus"), load(spark, sf_dir, "queries").select("query_id", "query_norm")
    queries.write.parquet(f"{tmp_path}/in")
    index = bm25.build(corpus)
    search_stream(spark.readStream.schema(queries.schema).parquet(f"{tmp_path}/in"), corpus, index, f"{tmp_path}/out", f"{tmp_path}/check", 5).awaitTermination()
    want = {(r.query_id, r["rank"]): r.doc_id for r in bm25.search(corpus, queries, index, 5).collect()}
    assert {(r.query_id, r["rank"]): r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_timings(spark):
    t = runtime.Timings()
    assert t.repeat("x", lambda: 3, 1, 2) == 3 and [r[:2] for r in t.rows] == [("x", 1), ("x", 2)]
    rows = [("a", i + 1, float(x)) for i, x in enumerate((1, 2, 3, 4, 5))] + [("b", 1, 10.0), ("b", 2, 20.0)]
    got = {r.operation: r for r in runtime.summarise(spark.createDataFrame(rows, "operation string, run int, ms double")).collect()}
    assert (got["a"].p50_ms, got["a"].p95_ms, got["a"].mean_ms, got["a"].min_ms, got["a"].max_ms, got["a"].n_runs) == (3.0, 4.8, 3.0, 1.0, 5.0, 5)
    assert (got["total"].n_runs, got["total"].min_ms, got["total"].max_ms) == (2, 11.0, 22.0)
    assert {r.operation for r in runtime.summarise(t.table(spark)).collect()} == {"x"}
    with pytest.raises(KeyError), t.of("broken"):
        raise KeyError
    assert t.rows[-1][0] == "broken"


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"retrieval": {"bm25": {"k1": 0.9}, "candidate_pool_sizes": [5, 7]}, "own": {"x": 1}}')
    s = runtime.read_settings(f"{tmp_path}/s.json")
    assert (s.k1, s.b, s.pool_sizes, s["own.x"]) == (0.9, 0.75, (5, 7), 1) and s is runtime.read_settings(f"{tmp_path}/s.json")
    with pytest.raises(KeyError, match="own.z"):
        s["own.z"]
    with pytest.raises(AttributeError):
        s.k1 = 2


def test_every_query_has_a_stable_schema(spark, sf_dir):
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert catalogue.queries()["hybrid_topk"](spark, sf_dir).count() > 0
