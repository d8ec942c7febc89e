"""Each operator against a brute-force version, and on the odd cases its docstring names."""

import collections
import itertools
import math
import random
import re
import textwrap
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankmill.llm import chunking, distinctive, dress, fuse_scores, leakage, near_items, queries, stuffing, tokenizing, top_n, visual_form
from rankmill.operators.storage import load, materialize

NAN = float("nan")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1


def best(data, n):
    groups = collections.defaultdict(dict)
    for g, doc, s, rank in data:
        if g is None or doc is None or s is None or s != s:
            continue
        key = (-s + 0.0, rank is None, rank or 0, doc)
        groups[g][doc] = min(key, groups[g].get(doc, key))
    return sorted((g, i + 1, k[3]) for g, docs in groups.items() for i, k in enumerate(sorted(docs.values())[:n]))


def test_top_n(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([*"defghijklmnop", None]), rng.choice([0.0, -0.0, 1.0, 2.5, None, NAN]), rng.choice([1, 2, None])) for _ in range(800)]
    df = spark.createDataFrame(data, "g string, d string, s double, r int").withColumn("place", F.lit("clash")).withColumn("__score", F.lit(1))
    got = top_n.top_n_per_group(df, ["g"], "d", "s", ["r"], 3)
    assert sorted((r.g, r.place, r.d) for r in got.collect()) == best(data, 3)
    assert top_n.top_n_per_group(df.limit(0), ["g"], "d", "s").count() == 0


def test_top_n_skips_row_groups(spark, tmp_path):
    df = spark.range(300_000).select(F.lit("hot").alias("g"), F.col("id").cast("string").alias("d"), F.rand(3).alias("s"))
    files = top_n.cluster_by_group(df, ["g"], "d", "s", [], f"file://{tmp_path}/t")
    counts = [top_n.scan_top_n(r.uri, 1, 0, 5) for r in files.collect()]
    assert sum(c[2] for c in counts) > 5 * sum(c[1] for c in counts) > 0
    want = [r.d for r in df.orderBy(F.col("s").desc(), "d").limit(5).collect()]
    got = top_n.top_n_of_clustered(files, df.schema, ["g"], "d", "s", [], 5).orderBy("place").collect()
    assert [r.d for r in got] == want


def test_row_groups_of_several_groups_are_skipped(spark, sf_dir, tmp_path):
    """On the test table most rows aren't read: groups share row groups, and those of lower bands are skipped whole."""
    df = load(spark, sf_dir.replace("0.001", "0.1"), "runs")
    files = top_n.cluster_by_group(df, ["query_id", "stage"], "doc_id", "score", ["rank"], f"file://{tmp_path}/t").collect()
    counts = [top_n.scan_top_n(r.uri, 2, 1, 10)[1:] for r in files]
    assert sum(r.n_row_groups for r in files) == sum(a + b for a, b in counts)
    assert sum(b for _, b in counts) > sum(a for a, _ in counts) > 0


@pytest.mark.parametrize("row_group,first_band", [(4, 1), (7, 3), (64, 16), (4096, 2)])
def test_clustered_files_against_brute_force(tmp_path, row_group, first_band):
    rng = random.Random(row_group)
    for trial in range(25):
        data = [(rng.choice(["a", "b", "c", "d", "e", "f"][: rng.randrange(1, 7)]), rng.choice("opqrstuvwxyz"), float(rng.randrange(6)), rng.choice([None, 1, 2])) for _ in range(rng.randrange(1, 200))]
        data.sort(key=lambda r: (r[0], -r[2], r[3] is None, r[3] or 0, r[1]))
        table = pa.table({"__g0": [r[0] for r in data], "__score": [r[2] for r in data], "__t0": pa.array([r[3] for r in data], pa.int32()), "__item": [r[1] for r in data]})
        uri = f"file://{tmp_path}/{trial}.parquet"
        n_rows, n_row_groups = top_n.write_clustered(iter(table.to_batches(max_chunksize=rng.randrange(1, 60))), uri, 1, row_group, first_band)
        for n in (1, 3, 20):
            got, read, skipped = top_n.scan_top_n(uri, 1, 1, n)
            ordered = sorted(got.to_pylist(), key=lambda r: (r["__g0"], -r["__score"], r["__t0"] is None, r["__t0"] or 0, r["__item"]))
            mine = [(g, i + 1, r["__item"]) for g, rs in itertools.groupby(ordered, lambda r: r["__g0"]) for i, r in enumerate(rs)]
            assert mine == best([(g, d, s, k) for g, d, s, k in data], n) and read + skipped == n_row_groups and n_rows == len(data)


# 2


def heaviest(corpus, texts):
    find = lambda t: re.findall("[a-z0-9]+", t) if t is not None and t.isascii() else []
    df = collections.Counter(w for t in corpus for w in set(find(t)))
    n = sum(1 for t in corpus if find(t))
    out = []
    for i, t in texts:
        tf = collections.Counter(w for w in find(t) if df[w])
        if tf:
            out.append((i, min((-round(c * math.log(n / df[w]), 6), w) for w, c in tf.items())[1]))
    return sorted(out)


@pytest.mark.parametrize("bound", [10**6, 0])
def test_distinctive(spark, bound):
    rng = random.Random(2)
    common = [f"c{i}" for i in range(8)]
    texts = [" ".join(rng.choices(common, k=rng.randrange(1, 60)) + rng.choices([f"r{i}" for i in range(300)], k=rng.randrange(4))) for _ in range(200)]
    texts += [None, "", "  ", "été abc", "UPPER", "c0 c0", "c1", "c1 " * 4000]
    data = [(f"d{i}", t) for i, t in enumerate(texts)] + [("d0", texts[0])]
    df = spark.createDataFrame(data, "id string, t string")
    vocab = materialize(distinctive.vocabulary(df, "t"), "v")
    own = distinctive.collection((df, "k", "id", "t"))
    got = distinctive.distinctive_terms(own, vocab, bound)
    all_texts = [t for _, t in data]
    assert sorted((r.rec_id, r.term) for r in got.collect()) == heaviest(all_texts, data)
    queries_ = distinctive.collection((spark.createDataFrame([("q", "zzz r1 c1"), ("p", "zzz"), (None, "c1")], "id string, t string"), "q", "id", "t"))
    assert [("q", "r1")] == [(r.rec_id, r.term) for r in distinctive.distinctive_terms(queries_, vocab, bound).collect() if r.rec_id]
    empty = materialize(distinctive.vocabulary(df.limit(0), "t"), "v")
    assert distinctive.distinctive_terms(own, empty, bound).count() == 0 == distinctive.ranked_terms(own, empty, bound).count()
    assert distinctive.ranked_terms(own.limit(0), vocab, bound).count() == 0


def models(texts):
    """Brute force: term -> probability of each text's parsimonious model, a term at a time."""
    find = lambda t: re.findall("[a-z0-9]+", t) if t is not None and t.isascii() else []
    n = collections.Counter(w for t in texts for w in set(find(t)))
    pairs, own, floor = sum(n.values()), distinctive.OWN, distinctive.FLOOR
    for t in texts:
        tf = collections.Counter(find(t))
        p, mass = {w: c / sum(tf.values()) for w, c in tf.items()}, 0.0
        for _ in range(distinctive.ROUNDS):
            e = {w: c * own * p[w] / (own * p[w] + (1 - own) * n[w] / pairs) for w, c in tf.items()}
            mass = sum(e.values())
            p = {w: x / mass for w, x in e.items()}
        yield {w: x for w, x in p.items() if x >= floor or tf[w] * own > mass * ((1 - own) * n[w] / pairs + own * floor)}, tf


@pytest.mark.parametrize("bound", [10**6, 0])
def test_ranking_by_converged_probability(spark, sf_dir, bound):
    texts = [r.text_norm for r in load(spark, sf_dir, "corpus").select("text_norm").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    vocab = materialize(distinctive.vocabulary(df, "t"), "v")
    got = collections.defaultdict(dict)
    for r in distinctive.ranked_terms(distinctive.collection((df, "k", "id", "t")), vocab, bound).collect():
        got[int(r.rec_id)][r.place] = (r.term, r.probability)
    kept = dropped = 0
    for i, (p, tf) in enumerate(models(texts)):
        want = sorted(((w, round(x, 6)) for w, x in p.items()), key=lambda x: (-x[1], x[0]))
        assert [got[i][k + 1][1] for k in range(len(got[i]))] == pytest.approx([x for _, x in want], abs=2e-6)
        assert {w for w, _ in got[i].values()} == set(p)
        kept, dropped = kept + len(p), dropped + len(tf) - len(p)
    assert dropped > 0.2 * kept  # the model gives common terms to the background


def test_parsimonious_gives_common_mass_to_background():
    p, alive = distinctive.parsimonious(np.array([0, 0]), np.array([5.0, 5.0]), np.array([0.5, 0.0001]), 1, own=0.2, rounds=200)
    assert p[1] > 0.99 and not alive[0] and alive[1]


def test_dropped_terms_stay_under_the_bound():
    rng = np.random.default_rng(3)
    for own in (0.1, 0.5, 0.9):
        n = rng.integers(1, 2000, 400)
        pairs = int(n.sum())
        tf = rng.integers(1, 6, 400).astype(float)
        _, alive = distinctive.parsimonious(np.zeros(400, int), tf, n / pairs, 1, own=own, rounds=100)
        weight = tf * np.log(2000 / n)
        assert weight[~alive].max(initial=0) <= distinctive.dropped_at_most(np.array([tf.sum()]), 2000, pairs / 2000, own)[0]


# 3


def winner(pool):
    out = []
    for x in pool:
        if len(pool) > 1 and all(sum(a > b for a, b in zip(x[1:], y[1:])) >= 2 for y in pool if y is not x):
            out.append(x[0])
    return out


def test_fusion_and_majority(spark):
    rng = random.Random(4)
    data, want = [], []
    for q in range(150):
        m = rng.choice([1, 2, 3, 5, 40 if q < 20 else 4])
        strong = rng.random() < 0.6
        pool = [(f"d{i}", *[float(rng.randrange(8)) * 10**k + (9 * 10**k if strong and i == 1 and k != q % 3 else 0) for k in range(3)]) for i in range(m)]
        data += [(f"q{q}", *p) for p in pool]
        want += [(f"q{q}", d) for d in winner(pool)]
    df = spark.createDataFrame(data, "q string, d string, a double, b double, c double")
    fused = fuse_scores.fuse(df, "q", "d", ["a", "b", "c"])
    by = collections.defaultdict(list)
    for r in data:
        by[r[0]].append(r)
    for r in fused.collect():
        own = next(x for x in by[r.q] if x[1] == r.d)
        assert r.rrf == pytest.approx(sum(1 / (61 + sum(y[k] > own[k] for y in by[r.q])) for k in (2, 3, 4)))
    assert rows(fuse_scores.majority_winner(fused, "q", "d", ["a", "b", "c"])) == sorted(want) and want


def test_fusion_odd_cases(spark):
    df = spark.createDataFrame([("q", "a", 1.0, None, NAN), ("q", "b", 1.0, 2.0, 3.0), (None, "c", 1.0, 1.0, 1.0), ("q", None, 9.0, 9.0, 9.0)], "q string, d string, a double, b double, c double")
    got = {r.d: r.rrf for r in fuse_scores.fuse(df, "q", "d", ["a", "b", "c"]).collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 3 / 61})
    empty = fuse_scores.fuse(df.limit(0), "q", "d", ["a", "b", "c"])
    assert empty.count() == 0 and fuse_scores.majority_winner(empty, "q", "d", ["a", "b", "c"]).count() == 0


def test_score_pool_takes_the_highest_valid_score(spark):
    runs = spark.createDataFrame([("q", "d", "bm25", 1.0), ("q", "d", "bm25", 3.0), ("q", "d", "bm25", NAN), ("q", "d", "dense", 0.5), ("q", "e", "bm25", 1.0), ("q", "e", "dense", None)], "query_id string, doc_id string, stage string, score double")
    reranked = spark.createDataFrame([("q", "d", -1.0), ("q", "d", None), ("q", "e", 1.0)], "query_id string, doc_id string, score double")
    assert rows(fuse_scores.score_pool(runs, reranked)) == [("q", "d", 3.0, 0.5, -1.0)]


# 4

LOOKS = [
    ("naïve ﬁne １２ a b", "naïve fine 12 a b"),
    ("soft", "so­f​t"),
    ("copy", "соpу"),
    ("five Ⅰ", "fⅰⅴe I"),
    ("co-op", "co‐op"),
    ("µg", "μg"),
    ("ë", "ё"),
]
OTHER = [("a b", "a  b"), ("a", "A"), ("e", "é"), ("x2", "x²"), ("a.", "a,"), ("β", "b"), ("a b", "a\nb"), ("1", "2")]


@pytest.mark.parametrize("a,b", LOOKS)
def test_same_look(a, b):
    assert a != b and visual_form.visible_form(a) == visual_form.visible_form(b) and visual_form.canonical_form(a) == visual_form.canonical_form(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(a, b):
    assert visual_form.visible_form(a) != visual_form.visible_form(b)


def test_forms_are_stable():
    for t in [x for p in LOOKS + OTHER for x in p] + ["", "ß ﬀ ½ ① ™ 한"]:
        assert visual_form.visible_form(visual_form.visible_form(t)) == visual_form.visible_form(t)
        assert visual_form.canonical_form(visual_form.canonical_form(t)) == visual_form.canonical_form(t)


def test_same_looking_pairs(spark):
    data = [("c", f"{i}{k}", t) for i, p in enumerate(LOOKS) for k, t in enumerate(p)] + [("q", "00", LOOKS[0][0]), ("c", "99", LOOKS[0][0]), ("c", "x", None), ("c", "y", ""), ("c", None, "soft"), ("c", "00", LOOKS[0][0])]
    df = spark.createDataFrame(data, "kind string, id string, text string")
    assert rows(visual_form.same_looking_pairs(df)) == sorted([("c", f"{i}0", f"{i}1") for i in range(len(LOOKS))] + [("c", "01", "99")])
    assert visual_form.same_looking_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [1, 3, 1000])
def test_pairs_in_cells_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(visual_form, "CELL", cell)
    rng = random.Random(13)
    texts = ["na\u00efve", "nai\u0308ve", "na\u00ef\u200bve", "plain", "pl\u200bain", "\uff50lain", "other", None, ""]
    data = [(rng.choice("cq"), f"i{rng.randrange(60):02}", rng.choice(texts)) for _ in range(150)]
    want = {(a[0], min(a[1], b[1]), max(a[1], b[1])) for a in data for b in data if a[2] and b[2] and a[0] == b[0] and a[1] != b[1] and a[2] != b[2] and visual_form.visible_form(a[2]) == visual_form.visible_form(b[2])}
    assert set(rows(visual_form.same_looking_pairs(spark.createDataFrame(data, "kind string, id string, text string")))) == want


def test_canonical_classes(spark, sf_dir):
    data = [("corpus", r.doc_id, r.text_raw) for r in load(spark, sf_dir, "corpus").collect()] + [("queries", r.query_id, r.query_raw) for r in load(spark, sf_dir, "queries").collect()]
    data += [("corpus", "x1", "TNF-\u03b1 Rise"), ("corpus", "x2", "tnf-a\u00a0rise"), ("corpus", "x2", "tnf-a\u00a0rise"), ("corpus", None, "a"), ("corpus", "x3", None), ("corpus", "x4", "")]
    groups = collections.defaultdict(set)
    for k, i, t in data:
        if i and t:
            groups[k, visual_form.canonical_form(t)].add(i)
    want = sorted((k, i, min(ids), len(ids)) for (k, _), ids in groups.items() for i in ids)
    df = spark.createDataFrame(data, "kind string, id string, text string")
    assert rows(visual_form.canonical_classes(df)) == want and ("corpus", "x2", "x1", 2) in want
    assert visual_form.canonical_classes(df.limit(0)).count() == 0


def test_letters_that_pass_for_ascii(tmp_path):
    for a, b in [("\u03c1", "p"), ("\u03b1", "a"), ("\u03c5", "u"), ("\u03b9", "i"), ("\u04c0", "l"), ("\ua4ee", "A"), ("\ua4d0", "B"), ("\u0251", "a"), ("\u1d04", "c"), ("\u2019", "'"), ("\u2212", "-")]:
        assert visual_form.canonical_form(a) == visual_form.canonical_form(b) and visual_form.visible_form(a) != visual_form.visible_form(b)
    (tmp_path / "c.txt").write_text("\ufeff# comment\n0433 ; 0072 ; MA # x\n0030 ; 004F ; MA\n1D41B ; 0062 ; MA\n", encoding="utf-8")
    table = visual_form.read_confusables(f"{tmp_path}/c.txt")
    assert visual_form.canonical_form("\u0433\u03b1", table) == "r\u03b1" and "0" not in table.values()


def test_many_copies_of_one_spelling(spark):
    hot = spark.range(60_000).select(F.lit("c").alias("kind"), F.format_string("h%06d", "id").alias("id"), F.lit("naïve text").alias("text"))
    other = spark.createDataFrame([("c", "z", "naïve te\u00adxt")], "kind string, id string, text string")
    assert visual_form.same_looking_pairs(hot.unionByName(other)).count() == 60_000


def test_columns_match_functions(spark):
    data = [(t,) for p in LOOKS + OTHER for t in p] + [("",), (None,), ("A\tB",)]
    df = spark.createDataFrame(data, "t string")
    for r in df.select("t", visual_form.canonical(F.col("t")).alias("c"), visual_form.visible(F.col("t")).alias("v")).collect():
        assert (r.c, r.v) == ((None, None) if r.t is None else (visual_form.canonical_form(r.t), visual_form.visible_form(r.t)))


# 5


def greedy_pieces(text):
    t = [x for x in re.split("[ \t\n]+", text) if x]
    ends = [i + 1 for i in range(len(t) - 1) if re.fullmatch(r""".*[.!?][)\]"']*""", t[i], re.S) and re.match("[A-Z]", t[i + 1])]
    out, first = [], 1
    while len(t) - first + 1 > 512:
        fit = [e for e in ends if first + 50 <= e <= first + 511]
        out.append((first, fit[-1] if fit else first + 511))
        first = out[-1][1] - 49
    return [*out, (first, len(t))] if out else []


def test_pieces(spark, sf_dir):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "b.", "C", "d!)", 'E?"']) for _ in range(n)) for n in (512, 513, 900, 3000)] + ["x " * 1200, "\n\t y" * 700, None, "", "   "]
    data = list(enumerate(texts))
    got = rows(chunking.split_oversized(spark.createDataFrame(data, "d long, t string"), "d", "t"))
    assert got == sorted((i, k + 1, *p) for i, t in data if t for k, p in enumerate(greedy_pieces(t)))
    corpus = load(spark, sf_dir.replace("0.001", "0.01"), "corpus")
    want = sorted((r.doc_id, k + 1, *p) for r in corpus.where("text_raw IS NOT NULL").collect() for k, p in enumerate(greedy_pieces(r.text_raw)))
    assert rows(chunking.split_oversized(corpus, "doc_id", "text_raw")) == want and want


def test_landmarks_against_brute_force():
    rng = random.Random(7)
    for reach in (1, 2, 5, 127):
        for n in (1, 2, 7, 300):
            tokens = [f"w{rng.randrange(40)}" for _ in range(n)]
            h = chunking.rolling_hashes(tokens).tolist()
            want = [i + 1 for i in range(n) if all(h[i] < h[j] for j in range(max(0, i - reach), min(n, i + reach + 1)) if j != i)]
            assert chunking.landmarks(tokens, reach).tolist() == want
    tokens = [f"t{i}" for i in range(30)]
    assert all(chunking.rolling_hashes(tokens[k:])[20] == chunking.rolling_hashes(tokens)[20 + k] for k in range(1, 9))


@pytest.mark.parametrize("vocabulary", [500, 3, 1])
def test_landmark_pieces_cover_within_sizes(vocabulary):
    rng = random.Random(8)
    for _ in range(20):
        tokens = [f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", "."]) for _ in range(rng.randrange(1, 5000))]
        tokens = [t.capitalize() if rng.random() < 0.5 else t for t in tokens]
        pieces = chunking.pieces_of(tokens, 64, 512, 50, 127)
        assert pieces[0][0] == 1 and pieces[-1][1] == len(tokens) and all(b - a < 512 for a, b in pieces)
        assert all(c == max(1, b - 49) for (_, b), (c, _) in zip(pieces, pieces[1:]))
        assert all(b - a + 1 >= 64 for a, b in pieces[:-1])


def test_an_edit_alters_neighbouring_pieces_only():
    """No cut changes before the edit by more than reach + snap + the minimum size, nor after the first landmark beyond reach + snap + WINDOW."""
    rng = random.Random(9)
    worst = 0
    for _ in range(60):
        tokens = [f"W{rng.randrange(500)}" + ("." if rng.random() < 0.05 else "") for _ in range(6000)]
        at, new = rng.randrange(1000, 4000), ["new"] * rng.randrange(1, 6)
        edited = tokens[:at] + new + tokens[at:]
        before = {b for _, b in chunking.pieces_of(tokens, 64, 512, 50, 127)}
        after = {b if b <= at else b - len(new) for _, b in chunking.pieces_of(edited, 64, 512, 50, 127)}
        marks = chunking.landmarks(tokens, 127)
        clear = at + 127 + 32 + chunking.WINDOW + 1
        resume = int(marks[np.searchsorted(marks, clear + 32)]) + 32
        changed = before ^ after
        assert all(at - 127 - 32 - 64 <= c <= resume for c in changed)
        worst = max(worst, *(c - at for c in changed), 0)
        assert len(before & after) >= len(before) - 6
    assert worst < 2000


def test_snapping_goes_to_the_nearest_boundary():
    assert chunking.snapped(np.array([10, 50, 90, 200]), np.array([4, 15, 47, 53, 120]), 6) == [15, 47, 90, 200]
    assert chunking.snapped(np.array([10]), np.array([], dtype=int), 6) == [10]
    for bad in ({"most": 10, "least": 5, "overlap": 5}, {"reach": 9}):
        with pytest.raises(ValueError):
            chunking.split_oversized(None, "d", "t", **bad)


# 6


def test_copies(spark):
    def strip(t):
        return "".join(c for c in t or "" if unicodedata.category(c)[0] in "LN").lower()

    data = [("3", "A b", "A b: some text"), ("1", "a-B", "some, text  a b"), ("2", None, "ab sometext"), ("4", "", "some text"), ("5", "ab", "SOME text"), ("6", "x", "--"), ("7", "x", None), ("8", None, ""), ("5", "ab", "SOME text"), ("9", "sometext", "ab some text"), (None, "ab", "some text")]
    data += [(f"h{i:03}", None, "Hot record!" if i % 2 else "hot  record") for i in range(200)]
    groups = collections.defaultdict(set)
    for i, t, x in data:
        t, x = strip(t), strip(x)
        if x and i:
            rest = x[len(t) :] if x.startswith(t) else x[: len(x) - len(t)] if x.endswith(t) else x
            groups[t, rest].add(i)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    df = spark.createDataFrame(data, "id string, title string, x string")
    assert rows(dress.copies_of_records(df, "id", "title", "x")) == want
    assert dress.copies_of_records(df.limit(0), "id", "title", "x").count() == 0


def test_equal_values_are_canonicalised_once(spark, monkeypatch):
    """Fifty rows that store the same pair, one that dresses it otherwise, one whose title and text only join to the same characters."""
    data = [(f"a{i:02}", "Ti", "Ti tle text") for i in range(50)] + [("b", "TI", "ti: tle, text"), ("c", "Ti tle", " text"), ("d", None, "Ti tle text"), ("e", "", "Ti tle text"), ("a00", "Ti", "Ti tle text"), ("a01", "Ti", "ti tle text!")]
    df = spark.createDataFrame(data, "id string, title string, x string")
    seen = []
    monkeypatch.setattr(dress, "materialize", lambda d, tag, keep=dress.materialize: seen.append((tag, keep(d, tag))) or seen[-1][1])
    want = [("a00", f"a{i:02}") for i in range(1, 50)] + [("a00", "b"), ("d", "e")]
    assert rows(dress.copies_of_records(df, "id", "title", "x")) == sorted(want)
    assert dict(seen)["known"].count() <= len({(t, x) for _, t, x in data}) + 1  # the row that stands twice


# 7

HARD = ["", " ", "  a", "a  ", "\n\n  x\r\ny", "it's we'll I'M", "aaaaaaaaaaaaaaaaa" * 40, " " * 300, "日本語テキスト 中文", "naïve ﬁ é ​﻿", "<|endoftext|> a", "👩‍👩‍👧 \U0001f600", "x\x1cy\x1f \x85z　w ", "1234567890 3.14 ½", "\x00\x01", "zzqqxxjj", "'S 'Re", "ÀÉ Ñandú", "İstanbul"]


def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    rng = random.Random(8)
    alphabet = "abcdeé tuTH'12.,\n-_日ﬁ"
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(1500)]
    data = [(i, x) for i, x in enumerate(texts)] + [(-1, None)]
    got = {r.d: r.ids for r in tokenizing.encode_corpus(spark.createDataFrame(data, "d long, t string"), "d", "t", queries.tokenizer_path()).collect()}
    want = {i: e.ids for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False))} | {-1: []}
    assert {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_encoding_of_documents(spark, sf_dir):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    docs = {r.doc_id: r.text or "" for r in load(spark, sf_dir.replace("0.001", "0.01"), "documents").collect()}
    got = {r.doc_id: r.ids for r in queries.p7_ids(spark, sf_dir.replace("0.001", "0.01")).collect()}
    want = dict(zip(docs, (e.ids for e in t.encode_batch(list(docs.values()), add_special_tokens=False))))
    assert got == want


def test_compatible_pairs_equal_merging():
    merges = tokenizing.Merges.from_file(queries.tokenizer_path())
    rng = np.random.default_rng(9)
    text = {i: t for t, i in merges.proposed.items()}
    short = np.array([i for i, t in text.items() if len(t) <= 4])
    a, b = rng.choice(short, 4000), rng.choice(short, 4000)
    same = rng.choice([i for i, t in text.items() if len(set(t)) == 1], (2, 300))
    a, b = np.concatenate([a, same[0]]), np.concatenate([b, same[1]])
    want = [merges.exact(text[x] + text[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert merges.compatible(a, b).tolist() == want and 0 < sum(want) < len(want)


# 8


def leaks(docs, items):
    out = set()
    grams = collections.defaultdict(set)
    for i, t in items:
        w = leakage.words_of(t)
        n = min(12, len(w))
        for k in range(len(w) - n + 1) if n else []:
            grams[tuple(w[k : k + n])].add(i)
    sizes = {len(g) for g in grams}
    for d, t in docs:
        w = leakage.words_of(t)
        for n in sizes:
            for k in range(len(w) - n + 1):
                out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return sorted(out)


@pytest.mark.parametrize("windows", [leakage.INDEX_WINDOWS, 4000])
def test_leaks(spark, sf_dir, windows):
    sf = sf_dir.replace("0.001", "0.01")
    docs, items = load(spark, sf, "documents"), load(spark, sf, "eval_items")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    want = leaks(pairs, [(r.item_id, r.text) for r in items.collect()])
    got = leakage.leaked_items(docs, "doc_id", "text", items, "item_id", "text", similarity=1.0, index_windows=windows)
    assert rows(got) == want and want


def test_leaks_odd_cases(spark):
    long = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(1, long), (2, "Alpha beta"), (3, None), (4, ""), (5, "?!"), (1, long)], "i long, t string")
    docs = [(1, "x " + " ".join(f"w{i}" for i in range(20, 32)) + " y"), (2, " ".join(f"w{i}" for i in range(20, 31))), (3, "ALPHA,\nBeta"), (4, "alpha x beta"), (5, None), (6, ""), (3, "ALPHA,\nBeta")]
    df = spark.createDataFrame(docs, "d long, t string")
    assert rows(leakage.leaked_items(df, "d", "t", items, "i", "t", similarity=1.0)) == [(1, 1), (3, 2)]
    assert leakage.leaked_items(df.limit(0), "d", "t", items, "i", "t").count() == 0
    assert leakage.leaked_items(df, "d", "t", items.limit(0), "i", "t").count() == 0


@pytest.mark.parametrize("similarity,near", [(0.8, 49), (0.5, 19)])
def test_near_copies_against_brute_force(spark, similarity, near):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    items = [(i, rng.choices(words, k=n)) for i, n in enumerate((3, 9, 14, 30, 49, 60, 80, 80))]
    docs = []
    for d in range(60):
        own = list(rng.choice(items)[1])
        for _ in range(d % 5):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = [f"new{d}"] * rng.randrange(1, 3)
        docs.append((d, rng.choices(words, k=rng.randrange(20)) + own + rng.choices(words, k=20)))
    want = set()
    for d, a in docs:
        for i, b in items:
            for size in (min(12, len(b)), min(near, len(b))):
                pairs = ((a[p : p + size], b[q : q + size]) for p in range(len(a) - size + 1) for q in range(len(b) - size + 1))
                if any(x == y or leakage.shingle_similarity(x, y) >= similarity for x, y in pairs if not {*x}.isdisjoint(y)):
                    want.add((d, i))
    tables = [spark.createDataFrame([(k, " ".join(w)) for k, w in x], "k long, t string") for x in (docs, items)]
    assert set(rows(leakage.leaked_items(tables[0], "k", "t", tables[1].withColumnRenamed("k", "i"), "i", "t", similarity=similarity))) == want


def test_one_changed_word_is_a_near_copy(spark):
    item = [f"w{i}" for i in range(49)]
    items = spark.createDataFrame([(1, " ".join(item))], "i long, t string")
    near = leakage.NearIndex([(1, " ".join(item))], 0.8)
    for k in range(49):
        assert near.found(" ".join(["x", *item[:k], "new", *item[k + 1 :], "y"])) == {1}
    assert near.found(" ".join(w if k % 11 else "new" for k, w in enumerate(item))) == set()
    edited = [w for k, w in enumerate(item * 2) if k % 10]
    assert leakage.leaked_items(spark.createDataFrame([(1, " ".join(edited))], "d long, t string"), "d", "t", items, "i", "t").count() == 0


def test_majorities_against_brute_force():
    rng = np.random.default_rng(21)
    bits = rng.integers(0, 1 << 63, 90, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 90, dtype=np.uint64)
    each = np.array([[int(b) >> k & 1 for k in range(64)] for b in bits])
    sums = leakage.BitSums(bits)
    for size in (1, 2, 3, 7, 8, 12, 33, 49, 64, 89, 90, 91):
        want = [sum(1 << k for k in range(64) if 2 * each[p : p + size, k].sum() > size) for p in range(90 - size + 1)]
        assert sums.majority(size).tolist() == want
        if len(want) > 3:
            assert sums.majority(size, np.array([2, 0, 3])).tolist() == [want[2], want[0], want[3]]


def changed(rng, words, share, vocabulary):
    out = list(words)
    for k in rng.sample(range(len(out)), round(share * len(out))):
        out[k] = rng.choice(vocabulary)
    return out


@pytest.mark.parametrize("share", [0, 0.05, 0.1, 0.2])
def test_recall_of_reworded_items(spark, sf_dir, share):
    """Items planted in documents of the table with this share of their words exchanged; recall is measured at the production parameters."""
    rng = random.Random(share)
    items = {r.item_id: leakage.words_of(r.text) for r in load(spark, sf_dir, "eval_items").collect()}
    texts = [leakage.words_of(r.text) for r in load(spark, sf_dir, "documents").collect() if r.text]
    vocabulary = [w for t in texts for w in t]
    docs = []
    for d, (i, w) in enumerate(items.items()):
        page = rng.choice(texts)
        at = rng.randrange(len(page) + 1)
        docs.append((d, i, " ".join(page[:at] + changed(rng, w, share, vocabulary) + page[at:])))
    df = spark.createDataFrame([(d, t) for d, _, t in docs], "d long, t string")
    got = set(rows(near_items.near_items(df, "d", "t", load(spark, sf_dir, "eval_items"), "item_id", "text", shingle=1, similarity=0.6, radius=19)))
    assert sum((d, i) in got for d, i, _ in docs) >= 0.9 * len(docs)
    for d, i in got:
        w, page = items[i], leakage.words_of(docs[d][2])
        assert any(leakage.shingle_similarity(page[p : p + len(w)], w, 1) >= 0.6 for p in range(len(page) - len(w) + 1))


def test_near_items_against_brute_force(spark):
    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, rng.choices(vocabulary, k=n)) for i, n in enumerate([1, 4, 5, 9, 20, 35, 35, 36, 48, 120, 400])]
    docs = []
    for d in range(150):
        w = list(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.choice([0, len(w) - 1, rng.randrange(len(w))])
            w[at : at + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(1, 2))
        docs.append((d, rng.choices(vocabulary, k=rng.choice([0, 3, 40])) + w + rng.choices(vocabulary, k=rng.choice([0, 30]))))
    want = {(d, i) for d, a in docs for i, b in items if any(leakage.shingle_similarity(a[p : p + len(b)], b) >= 0.8 for p in range(len(a) - len(b) + 1))}
    tables = [spark.createDataFrame([(k, " ".join(w)) for k, w in x], "k long, t string") for x in (docs, items)]
    for entries in (near_items.INDEX_ENTRIES, 500):
        got = set(rows(near_items.near_items(tables[0], "k", "t", tables[1].withColumnRenamed("k", "i"), "i", "t", index_entries=entries)))
        assert got <= want and len(got) >= 0.97 * len(want) > 0


def test_near_items_odd_cases(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, None), (3, ""), (4, "?!"), (1, "a b c d e f g h i j k l m n")], "i long, t string")
    docs = spark.createDataFrame([(1, "x A b c d e f g h i j k l m, N y"), (2, "a b c d e f g h i j k l m"), (3, None), (4, ""), (1, "x A b c d e f g h i j k l m, N y"), (None, "a b c d e f g h i j k l m n")], "d long, t string")
    assert rows(near_items.near_items(docs, "d", "t", items, "i", "t")) == [(1, 1)]
    assert near_items.near_items(docs.limit(0), "d", "t", items, "i", "t").count() == 0 == near_items.near_items(docs, "d", "t", items.limit(0), "i", "t").count()
    with pytest.raises(ValueError):
        near_items.near_items(docs, "d", "t", items, "i", "t", radius=64)


def test_multi_index_of_items_is_complete():
    rng = np.random.default_rng(15)
    index = near_items.ItemIndex([(i, " ".join(rng.choice([f"v{k}" for k in range(60)], 35))) for i in range(80)], 11, 5, 0.8)
    probe = index.prints[rng.integers(0, 80, 400)]
    for _ in range(12):
        probe = probe ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    size = next(iter(index.sizes))
    left, right = index.candidates(size, probe)
    want = {(i, j) for i in range(400) for j in np.flatnonzero(np.bitwise_count(index.prints ^ probe[i]) <= 11)}
    assert set(zip(left.tolist(), right.tolist())) == want and want


def test_windows_of_texts():
    rng = random.Random(16)
    for _ in range(200):
        lengths = [rng.choice([0, 0, 1, 5, 30]) for _ in range(6)]
        end = np.cumsum(lengths)
        begin, size, stride = end - lengths, rng.randrange(1, 8), rng.randrange(1, 4)
        want = sorted({int(b) + min(k, n - size) for b, n in zip(begin, lengths) if n >= size for k in range(0, n - size + stride, stride)})
        cut = rng.randrange(int(end[-1]) + 1)
        got = [near_items.window_starts(begin, end, size, stride, a, b).tolist() for a, b in ((0, cut), (cut, int(end[-1])))]
        assert sorted({*got[0], *got[1]}) == want


def test_multi_index_is_complete():
    rng = np.random.default_rng(10)
    index = leakage.WindowIndex([(i, " ".join(rng.choice([f"v{k}" for k in range(60)], 30))) for i in range(40)])
    own = index.sizes[12][2]
    probe = own[rng.integers(0, len(own), 500)] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    left, right = index.candidates(12, probe)
    want = {(i, j) for i in range(500) for j in np.flatnonzero(np.bitwise_count(own ^ probe[i]) <= 3)}
    assert set(zip(left.tolist(), right.tolist())) == want


# 9

SENTENCE = "The trial was stopped early because the patients in the second group had a rise in pressure. "
SPAM = "buy zesnium online, order folnone, cheap zesnium, zesnium tablets, order folnone, buy zesnium online, "


@pytest.mark.parametrize(
    "text,share",
    [
        (None, 0),
        ("", 0),
        ("  \n", 0),
        ("?!", 0),
        (SENTENCE * 20, 0),
        (SPAM * 5, 1),
        (SPAM * 5 + "\n" + SENTENCE, 1),
        (SENTENCE * 6 + "\n" + SPAM, 0),
        ("\n".join(f"https://shop{i}.example/a{i}/b?id={i}" for i in range(20)), 1),
        ("\n".join(f'<a href="http://h{i}.test/x">drug{i} clinic</a>' for i in range(20)), 1),
        (" ".join(f"#tag{i % 5}" for i in range(40)), 1),
        ("Home | Cart | Blog | Login | " * 10, 1),
        ("Arm | n | mean | sd\n" + SENTENCE * 4, 0),
        ("我们认为这可能参与了组织修复的早期过程。" * 10, 0),
        ("Schwere Nebenwirkungen traten unter dem Mittel nicht häufiger auf als unter Placebo. " * 9, 0),
    ],
)
def test_stuffing(text, share):
    assert (stuffing.stuffed_share(text) > 0.5) == bool(share)


LOCAL = [f"anemia of inflammation {kind} {place}" for place in ("Norring", "Dunmere", "Kestrel Bay", "Port Ellory", "Villa Sarón") for kind in ("clinic", "doctor", "treatment")]


@pytest.mark.parametrize("mark", ["\n", ", ", "; ", " | ", " "])
def test_keywords_that_hold_function_words(mark):
    assert stuffing.stuffed_share(mark.join(LOCAL)) > 0.9
    assert stuffing.stuffed_share(mark.join(LOCAL).capitalize()) > 0.9
    assert 0.5 < stuffing.stuffed_share(SENTENCE + "\n" + mark.join(LOCAL) + "\n" + SENTENCE) < 0.9
    assert stuffing.stuffed_share(SENTENCE * 12 + "\n" + mark.join(LOCAL)) < 0.5


PLACES = ["北京", "上海", "广州", "南京", "成都", "武汉"]


@pytest.mark.parametrize("mark", ["\n", " ", "，", " | "])
@pytest.mark.parametrize("keyword", ["高血压治疗医院", "高血压的治疗方法", "高血圧クリニック"])
def test_han_and_kana_keywords(keyword, mark):
    page = mark.join(f"{p}{keyword}" for p in PLACES * 4)
    assert stuffing.stuffed_share(page) > 0.9
    prose = "我们认为这可能参与了组织修复的早期过程。两组之间的不良反应没有明显差别，本研究评估了其对慢性炎症的影响。"
    assert stuffing.stuffed_share(prose + "\n" + page) > 0.5
    assert stuffing.stuffed_share(prose * 20 + "\n" + mark.join([keyword] * 5)) == 0.0


def test_han_prose_is_no_stuffing():
    prose = "我们认为这可能参与了组织修复的早期过程。两组之间的不良反应没有明显差别，本研究评估了其对慢性炎症的影响。随访期间未发现新的安全性问题。"
    assert stuffing.stuffed_share(prose * 20) == 0.0
    assert stuffing.stuffed_share("\n".join(textwrap.wrap(prose * 20, 18))) == 0.0
    assert stuffing.stuffed_share("随访期间未发现新的安全性问题\n结果显示其表达水平升高了一倍") == 0.0


@pytest.mark.parametrize("width", [30, 60, 90])
def test_cut_lines_of_prose_are_no_keywords(width):
    assert stuffing.stuffed_share(textwrap.fill(SENTENCE * 40, width)) == 0.0
    assert stuffing.stuffed_share(textwrap.fill((SENTENCE * 40).lower(), width)) == 0.0


def test_suffix_array_against_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        s = [rng.randrange(rng.choice([1, 3, 30])) for _ in range(rng.randrange(0, 24))]
        for times in (2, 3):
            got = stuffing.repeated_prefix(np.array(s, dtype=np.int64), times)
            for at in range(len(s)):
                fits = [n for n in range(1, len(s) - at + 1) if sum(s[k : k + n] == s[at : at + n] for k in range(len(s) - n + 1)) >= times]
                assert got[at] == max(fits, default=0)


def test_covered_places():
    assert stuffing.covered_by(np.array([0, 3, 2, 1, 0, 1]), 2).tolist() == [False, True, True, True, False, False]
    assert stuffing.covered_by(np.zeros(0, dtype=np.int64), 2).tolist() == []


# Short vocabularies of languages that the test tables don't hold, to shuffle into sentences.
ELSEWHERE = {
    "pl": "nie jest to w na się że do z o jak ale po co tak za od czy już tylko przez pacjent leczenie badanie wynik grupa choroba lek dawka ryzyko objaw lekarz szpital krew serce wiek rok miesiąc dzień przed może",
    "ru": "и в не на я что он с как это по но они к у из мы за вы от так о же пациент лечение исследование результат группа болезнь препарат доза риск симптом врач больница кровь сердце возраст год месяц день",
    "it": "il di che non è la per un in sono mi ho lo con si ma una gli da al paziente trattamento studio risultato gruppo malattia farmaco dose rischio sintomo medico ospedale sangue cuore età anno mese giorno prima può",
    "hi": "है के में की से को का और यह पर भी एक हैं नहीं था कि इस लिए रोगी उपचार अध्ययन परिणाम समूह रोग दवा खुराक जोखिम लक्षण चिकित्सक अस्पताल रक्त हृदय आयु वर्ष माह दिन",
}


@pytest.mark.parametrize("language", ELSEWHERE)
@pytest.mark.parametrize("skewed", [False, True])
def test_pages_in_other_languages_are_no_stuffing(language, skewed):
    words = ELSEWHERE[language].split()
    weights = [1 / (i + 1) if skewed else 1 for i in range(len(words))]
    end = "।" if language == "hi" else "."
    flagged = 0
    for k in range(100):
        rng = random.Random(k)
        page = " ".join(" ".join(rng.choices(words, weights, k=rng.randrange(6, 16))).capitalize() + end for _ in range(40))
        flagged += stuffing.stuffed_share(page) > 0.5 or stuffing.stuffed_share(textwrap.fill(page, 70)) > 0.5
    assert flagged == 0
    keywords = [f"{a} {b}" for a in words[-4:] for b in words[-9:-5]]
    assert stuffing.stuffed_share(" | ".join(keywords * 3)) > 0.9 and stuffing.stuffed_share("\n".join(keywords * 3)) > 0.9


def test_pages_together_are_judged_as_alone(spark, sf_dir, monkeypatch):
    texts = [r.text for r in load(spark, sf_dir.replace("0.001", "0.01"), "documents").collect()] + [None, "", "<a href", "> x", SPAM, "<b " + SPAM, "?!", SENTENCE]
    alone = [stuffing.stuffed_share(t) for t in texts]
    for together in (1, 3000, stuffing.TOGETHER):
        monkeypatch.setattr(stuffing, "TOGETHER", together)
        assert stuffing.stuffed_shares(texts) == alone
    assert sum(s > 0.5 for s in alone) > 20


def test_long_pages_and_marks():
    assert stuffing.stuffed_share("<" + "x " * 300 + "> " + SENTENCE * 3) == 0.0  # a tag of any length is markup
    assert stuffing.stuffed_share("It fell (p < 0.02). " + SENTENCE * 3 + "\n" + SPAM * 8 + " > home") > 0.5  # a sign is none
    urls = "\n".join(f"https://shop{i}.example/a{i}/b" for i in range(20))
    assert stuffing.stuffed_share(urls + "\nmRNA levels followed the same pattern.") > 0.9
    assert stuffing.stuffed_share(urls + "\n" + ". ".join(LOCAL) + ".") > 0.9
    assert stuffing.stuffed_share("We describe it at https://host.example/page in full, and the tables are there. " * 8) == 0.0
    assert stuffing.stuffed_share(SENTENCE * 4 + "\ud800 lone \U000e0041") == 0.0
    rng = random.Random(20)
    names = [f"drug{i}" for i in range(9)]
    assert stuffing.stuffed_share(" ".join(rng.choices(names, k=50_000))) == 1.0  # shuffled, without a mark


def test_stuffed_pages(spark):
    df = spark.createDataFrame([(1, SPAM * 4), (2, SENTENCE), (3, None), (4, ""), (None, SPAM * 4), (1, SPAM * 4), (5, SPAM * 3000)], "d long, t string")
    assert rows(stuffing.stuffed_pages(df, "d", "t")) == [(1,), (1,), (5,)]
    assert stuffing.stuffed_pages(df.limit(0), "d", "t").count() == 0


def test_registered_queries_run(spark, sf_dir):
    assert set(queries.oracle_sql()) <= set(queries.queries())
    for n in range(1, 10):
        assert any(q.startswith(f"p{n}_") for q in queries.queries())
