import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpuslab.functions import tokens as tk
from corpuslab.functions.text import normalize_text
from corpuslab.operators import features as feats
from corpuslab.operators import neighbours, sparse_neighbours

TEXTS = [
    "The tree of life, a tree", "the tree grows", "Life of the mind", "mind the tree tree gap",
    "the", "rare words only here", "the life of trees", "grows the tree of life", "gap", "the mind",
]


def grams(text, longest):
    tokens = re.findall(r"\w\w+", text.lower())
    return [" ".join(tokens[i : i + n]) for n in range(1, longest + 1) for i in range(len(tokens) - n + 1)]


def brute_vocabulary(texts, longest, low, high):
    df = Counter(t for x in texts for t in set(grams(x, longest)))
    n = len(texts)
    return {t: (c, math.log((1 + n) / (1 + c)) + 1) for t, c in df.items() if low * n <= c <= high * n}


def brute_tfidf(text, vocabulary, longest):
    tf = Counter(g for g in grams(text, longest) if g in vocabulary)
    raw = {t: c * vocabulary[t][1] for t, c in tf.items()}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    return {t: v / norm for t, v in raw.items()}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").cache()


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_vocabulary_and_tfidf(corpus, longest):
    fitted = feats.fit_vocabulary(corpus, longest=longest, min_share=0.2, max_share=0.7)
    want = brute_vocabulary(TEXTS, longest, 0.2, 0.7)
    got = {r["term"]: (r["df"], r["idf"]) for r in fitted.collect()}
    assert got.keys() == want.keys()
    assert all(got[t][0] == want[t][0] and math.isclose(got[t][1], want[t][1]) for t in want)
    weights = {}
    for r in feats.tfidf(corpus, fitted, longest=longest).collect():
        weights.setdefault(r["id"], {})[r["term"]] = r["weight"]
    for i, text in enumerate(TEXTS):
        brute = brute_tfidf(text, want, longest)
        assert weights.get(i, {}).keys() == brute.keys()
        assert all(math.isclose(weights[i][t], v) for t, v in brute.items())


@pytest.mark.parametrize("capacity", [1, 10])
def test_small_summaries_are_exact(corpus, capacity):
    """Grams that fall out of a task's summary are never frequent ones."""
    whole = sorted(feats.fit_vocabulary(corpus, longest=3, min_share=0.2).collect())
    assert sorted(feats.fit_vocabulary(corpus, longest=3, min_share=0.2, capacity=capacity).collect()) == whole


def test_summaries_bound_the_counts(spark, corpus):
    tokens = feats.token_table(corpus.repartition(3))
    merged = {r["term"]: r["n"] for r in feats._summaries(tokens, 2, 4).collect()}
    taken = merged.pop(None)
    assert taken > 0
    true = Counter(t for x in TEXTS for t in set(grams(x, 2)))
    assert all(merged.get(t, 0) <= n <= merged.get(t, 0) + taken for t, n in true.items())


def test_random_texts(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, rng.integers(0, 60)) if k < 40) for _ in range(120)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    fitted = feats.fit_vocabulary(docs, longest=3, capacity=30)
    want = brute_vocabulary([t or "" for t in texts], 3, 0.05, 0.9)
    assert {r["term"]: r["df"] for r in fitted.collect()} == {t: c for t, (c, _) in want.items()}
    got = {}
    for r in feats.tfidf(docs, fitted, longest=3).collect():
        got.setdefault(r["id"], {})[r["term"]] = (r["tf"], r["weight"])
    for i, text in enumerate(texts):
        brute = brute_tfidf(text or "", want, 3) if any(g in want for g in grams(text or "", 3)) else {}
        assert got.get(i, {}).keys() == brute.keys()
        assert all(math.isclose(got[i][t][1], v) for t, v in brute.items())


def test_too_large_a_vocabulary_is_refused(corpus, monkeypatch):
    monkeypatch.setattr(feats, "MOST_TERMS", 3)
    with pytest.raises(ValueError, match="minimum share"):
        feats.fit_vocabulary(corpus, min_share=0.1)


def test_vectors_equal_relational_form(corpus):
    model = feats.fit_tfidf_vectors(corpus, min_share=0.2, max_share=0.7)
    terms = model.stages[0].vocabulary
    fitted = feats.fit_vocabulary(corpus, min_share=0.2, max_share=0.7)
    weights = {(r["id"], r["term"]): r["weight"] for r in feats.tfidf(corpus, fitted).collect()}
    rows = feats.apply_tfidf_vectors(model, corpus).select("id", vector_to_array("features").alias("v")).collect()
    dense = {(r["id"], terms[i]): x for r in rows for i, x in enumerate(r["v"]) if x}
    assert dense.keys() == weights.keys()
    assert all(math.isclose(dense[k], weights[k]) for k in weights)


def test_texts_are_cut_into_words_once_for_vectors(corpus, monkeypatch):
    """Not once for each word of a gram, and without a difference to the grams as one expression, in slices of any size."""
    model = feats.fit_tfidf_vectors(corpus, longest=3, min_share=0.2, max_share=0.7)
    texts = corpus.unionByName(corpus.sparkSession.createDataFrame([(100, None), (101, ""), (102, "the the the tree of the tree of")], corpus.schema)).coalesce(2)
    for longest in (1, 2, 3):
        known = sorted(feats._words_in(model.stages[0].vocabulary))
        cut = tk.feature_words(normalize_text(F.col("text")))
        want = sorted(model.transform(texts.withColumn("tokens", tk.ngrams(tk.keep_only(cut, known), longest))).select("id", "features").collect())
        for tokens in (250_000, 3):
            monkeypatch.setattr(feats, "SLICE_TOKENS", tokens)
            found = feats.apply_tfidf_vectors(model, texts, longest=longest)
            assert sorted(found.select("id", "features").collect()) == want
        assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_vectors_of_a_token_table(corpus):
    """Tokens that are written serve the fit and the vectors; the texts are not cut again."""
    model = feats.fit_tfidf_vectors(corpus, min_share=0.2, max_share=0.7)
    found = feats.apply_tfidf_vectors(model, feats.token_table(corpus, "id"))
    assert found.columns == ["id", "features"]
    assert sorted(found.collect()) == sorted(feats.apply_tfidf_vectors(model, corpus).select("id", "features").collect())


def test_no_shuffle_after_the_vocabulary(corpus):
    fitted = feats.fit_vocabulary(corpus, min_share=0.2)
    plan = feats.tfidf(corpus, fitted)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# --- nearest neighbours -----------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(0, 4, 3)], int(i % 3)) for i in range(80)]
    return rows, spark.createDataFrame(rows, "id long, vector array<double>, label int")


def brute_nearest(rows, k, metric):
    out = {}
    for i, v, _ in rows:
        v = np.array(v)
        found = []
        for j, w, _ in rows:
            if i == j:
                continue
            w = np.array(w)
            if metric == "l2":
                d = float(np.sqrt(((w - v) ** 2).sum()))
            else:
                norms = np.linalg.norm(v) * np.linalg.norm(w)
                d = 1 - float(v @ w / norms) if norms else 1.0
            found.append((round(d, 9), j))
        out[i] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("k,metric,group_rows", [(1, "l2", 4096), (5, "l2", 7), (200, "l2", 7), (5, "cosine", 7)])
def test_nearest(points, k, metric, group_rows, monkeypatch):
    rows, df = points
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 30)
    got = {}
    for r in neighbours.nearest(df, df, k, metric, group_rows=group_rows).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (round(r["distance"], 9), r["neighbour_id"])
    want = brute_nearest(rows, k, metric)
    assert got.keys() == want.keys()
    for i, n in got.items():
        mine = [n[j] for j in sorted(n)]
        # Cosine distances that are equal up to rounding may be in either order.
        assert mine == want[i] if metric == "l2" else [d for d, _ in mine] == pytest.approx([d for d, _ in want[i]])


def clustered(n, seed=1, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d)) * 40
    return centres[rng.integers(12, size=n)] + rng.standard_normal((n, d))


def test_search_compares_few_pairs():
    """Cells beyond the bound are closed: far fewer than all pairs, and the result is exact."""
    base, k = clustered(1500), 5
    points = clustered(300, 2)
    cells = neighbours.Cells(base[:40], "l2")
    own, far = cells.place(base)
    low, high = np.full(40, np.inf), np.full(40, -np.inf)
    np.minimum.at(low, own, far[np.arange(len(own)), own])
    np.maximum.at(high, own, far[np.arange(len(own)), own])
    cells.know(low, high)
    ids, labels = np.arange(1500), np.zeros(1500, np.int64)
    best, compared = neighbours.search_group(cells, np.arange(300) + 9000, points, np.full(300, np.inf), ids, base, labels, own, k, False)
    exact = np.sqrt(((points[:, None] - base) ** 2).sum(axis=2))
    assert (best.id == np.argsort(exact, axis=1, kind="stable")[:, :k]).all()
    assert compared < 0.35 * 300 * 1500


def test_lower_bounds_hold():
    base, points = clustered(400), clustered(100, 3)
    cells = neighbours.Cells(base[:30], "l2")
    own, far = cells.place(base)
    low, high = np.full(30, np.inf), np.full(30, -np.inf)
    np.minimum.at(low, own, far[np.arange(len(own)), own])
    np.maximum.at(high, own, far[np.arange(len(own)), own])
    cells.know(low, high)
    exact = np.sqrt(((points[:, None] - base) ** 2).sum(axis=2))
    assert (cells.lower(points)[:, own] <= exact).all()


def test_a_cell_of_copies_is_dealt_over_groups(spark, points):
    """A third of all rows are copies of one vector: no group gets them all, the result is exact."""
    rows = points[0] + [(1000 + i, [2.0, 2.0, 2.0], 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    got = {}
    for r in neighbours.nearest(df, df, 3, group_rows=8).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (round(r["distance"], 9), r["neighbour_id"])
    assert {i: [n[j] for j in sorted(n)] for i, n in got.items()} == brute_nearest(rows, 3, "l2")
    groups = neighbours.Groups.pack(np.array([3, 50, 4, 0, 5]), np.arange(5), 8)
    assert groups.parts.tolist() == [1, 7, 1, 1, 1]
    dealt = np.bincount(groups.of(np.full(500, 1), np.arange(500)))
    assert (dealt > 0).sum() == 7 and dealt.max() < 120


def test_nearest_of_nothing(spark, points):
    _, df = points
    assert neighbours.nearest(df, df.limit(0), 3).collect() == []
    assert neighbours.nearest(df.limit(0), df, 3).collect() == []


def test_searches_ask_for_every_id(spark, tmp_path, monkeypatch):
    """Queries are all ids, against all rows; float vectors are written and shuffled as floats."""
    from corpuslab.plans.catalog import QUERIES

    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(6).astype(np.float32)], int(i % 2)) for i in range(-20, 95)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    kinds, written = [], neighbours.materialize
    monkeypatch.setattr(neighbours, "materialize", lambda df, label="table": kinds.extend(t for c, t in df.dtypes if c == "vector") or written(df, label))
    got = {}
    for r in QUERIES["similar_topk"](spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["neighbour_id"]
    want = brute_nearest(rows, 20, "cosine")
    assert {i: [n[j] for j in sorted(n)] for i, n in got.items()} == {i: [j for _, j in want[i]] for i in range(-20, 95)}
    assert sorted(r["vec_id"] for r in QUERIES["knn_classify"](spark, str(tmp_path)).collect()) == list(range(-20, 95))
    assert set(kinds) == {"array<float>"}


# --- sparse rows -----------------------------------------------------------------------


def sparse_rows(n, seed, terms=60):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        t = np.unique(rng.zipf(1.4, rng.integers(0, 14)) % terms)
        w = rng.integers(1, 5, len(t)).astype(float)
        w = w / np.linalg.norm(w) if len(w) else w
        out.append((i, [int(x) for x in t], [float(x) for x in w], int(i % 2)))
    return out + [(n + j, out[3][1], out[3][2], 1) for j in range(n // 2)]


def spread(rows, terms=60):
    m = np.zeros((len(rows), terms))
    for k, (_, t, w, _) in enumerate(rows):
        m[k, t] = w
    return m


@pytest.mark.parametrize("k,group_rows", [(1, 4096), (4, 25), (500, 25)])
def test_nearest_sparse(spark, k, group_rows):
    schema = "id long, terms array<int>, weights array<double>, label int"
    base, asked = sparse_rows(150, 1), sparse_rows(60, 2)
    found = sparse_neighbours.nearest_sparse(spark.createDataFrame(asked, schema), spark.createDataFrame(base, schema), k, group_rows=group_rows)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["neighbour_id"], r["label"])
    exact = np.sqrt(np.round(((spread(asked)[:, None] - spread(base)) ** 2).sum(axis=2), 9))
    assert len(got) == len(asked)
    for i, n in got.items():
        want = np.argsort(exact[i], kind="stable")[:k]
        assert [n[j] for j in sorted(n)] == [(base[b][0], base[b][3]) for b in want]


def test_inverted_lists_read_few_entries():
    """Copies are found within a close limit by the heaviest terms' lists and a few rows of their own."""
    base = [r for r in sparse_rows(2000, 3, 4000) if r[1]]
    asked = [r for r in base[:60] if len(r[1]) > 4]
    flat = lambda rows: sparse_neighbours._flat(*(pa.array([r[c] for r in rows], pa.list_(t)) for c, t in ((1, pa.int32()), (2, pa.float64()))))
    ids, labels = np.arange(len(base)), np.zeros(len(base), np.int64)
    found = {}
    for limit in (0.3, np.inf):
        best, read = sparse_neighbours.search_group(flat(asked), np.arange(len(asked)), np.full(len(asked), limit), flat(base), ids, labels, 1, False)
        found[limit] = (best.id, read)
    assert (found[0.3][0] == found[np.inf][0]).all() and found[0.3][1] < found[np.inf][1]


def test_vote(spark):
    rows = [(1, 1), (1, 0), (1, 1), (2, 0), (2, 1)]
    df = spark.createDataFrame(rows, "query_id long, label int")
    got = {r["query_id"]: (r["pred_y"], r["prob_y"]) for r in neighbours.vote(df).collect()}
    assert got == {1: (1, 2 / 3), 2: (0, 0.5)}


def test_grams_are_numbered_a_bounded_number_of_tokens_at_a_time(spark, corpus, monkeypatch):
    whole = sorted(feats.fit_vocabulary(corpus, longest=2, min_share=0.2).collect())
    weights = feats.tfidf(corpus, feats.fit_vocabulary(corpus, longest=2, min_share=0.2)).orderBy("id", "term").collect()
    monkeypatch.setattr(feats, "SLICE_TOKENS", 3)
    assert sorted(feats.fit_vocabulary(corpus, longest=2, min_share=0.2).collect()) == whole
    again = feats.tfidf(corpus, feats.fit_vocabulary(corpus, longest=2, min_share=0.2)).orderBy("id", "term").collect()
    assert [r[:3] for r in again] == [r[:3] for r in weights] and np.allclose([r[3] for r in again], [r[3] for r in weights])
    lists = pa.RecordBatch.from_arrays([pa.array([["a"] * n for n in (1, 2, 5, 0, 2, 0)])], ["tokens"])
    parts = [[len(x) for x in p.column(0).to_pylist()] for p in feats._slices(lists.slice(1))]
    assert parts == [[2], [5], [0, 2, 0]]


def test_summaries_hold_grams_of_frequent_words_alone(spark, monkeypatch):
    seen, summaries = [], feats._summaries
    monkeypatch.setattr(feats, "_summaries", lambda *a: seen.append(summaries(*a)) or seen[-1])
    docs = spark.createDataFrame([(f"common words and rare{i} words{i}",) for i in range(40)], "text string")
    terms = {r["term"] for r in feats.fit_vocabulary(docs, max_share=1.0).collect()}
    assert terms == {"common", "words", "and", "common words", "words and"}
    assert {r["term"] for r in seen[0].collect()} == terms | {None}
