"""Duplicates, joins, labels and roll-ups on hand-written rows."""
import pytest
from pyspark.sql import functions as F

from corpuslab import schemas
from corpuslab.operators import dedupe, joins, labels, rollup
from corpuslab.operators import statistics as stats

LONG = "y" * 101


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "i int, v string")
    assert rows(dedupe.dedup_first(df)) == [(1, "a"), (2, None), (3, "c")]
    assert rows(dedupe.dedup_none(df)) == [(3, "c")]
    assert rows(dedupe.dedup_first(dedupe.dedup_first(df))) == rows(dedupe.dedup_first(df))


def test_latest_version(spark):
    df = spark.createDataFrame(
        [("a", 2, "av2.b"), ("a", 10, "av10.a"), ("a", 10, "av10.b"), ("b", 1, "bv1.a")],
        "id string, version int, name string",
    )
    assert rows(dedupe.latest_version(df, "id", "version", "name"), "name") == [("av10.a",), ("bv1.a",)]


def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = dedupe.first_per_key(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_ingest_exact(spark):
    files = spark.createDataFrame(
        [("p/1", "a", "short"), ("p/2", "a", LONG), ("p/3", "a", LONG + "z"), ("p/4", "b", LONG),
         ("p/5", "c", LONG)],
        "path string, id string, text string",
    )
    metadata = spark.createDataFrame([("a", 1), ("b", 0), ("b", 1), ("d", 1)], "ID string, Binary int")
    got = rows(joins.ingest_exact(files, metadata, keep=["Binary"], quote_ids=True))
    assert got == sorted(
        [('"a"', "short", 0, 1), ('"a"', LONG, 1, 1), ('"b"', LONG, 1, 0), ('"b"', LONG, 1, 1)], key=repr
    )
    every = joins.ingest_exact(files, metadata, first_file_only=False)
    assert every.where("id = 'a'").count() == 3
    assert rows(joins.orphans(files, metadata), "path") == [("p/5",)]


def test_ingest_versioned(spark):
    text = LONG + " beast"
    files = spark.createDataFrame(
        [("a", 1, text), ("a", 2, text), ("b", 1, text), ("c", 1, LONG), ("d", 1, " beast")],
        "id string, version int, text string",
    )
    metadata = spark.createDataFrame(
        [("a", 1, "t"), ("a", 1, "t"), ("b", 1, "t"), ("b", 1, "other"), ("c", 1, "t"), ("d", 1, "t")],
        "ID string, Version int, Title string",
    )
    assert rows(joins.ingest_versioned(files, metadata)) == [("a", text, 1)]


def test_positional_join(spark):
    left = spark.range(1000).select((999 - F.col("id")).alias("l"))
    right = spark.range(1000).select((F.col("id") * 3).alias("r")).repartition(5)
    got = rows(joins.positional_join(left, ["l"], right, ["r"]), "row_index", "l", "r")
    assert sorted(got) == [(i, i, 3 * i) for i in range(1000)]


@pytest.fixture(scope="module")
def metadata(spark):
    def row(i, usable, binary):
        return (i, "au", "ti", "jo", 2000, usable, 0, 0, 0, 0, 0, binary)

    return spark.createDataFrame(
        [row("1", 1, 1), row("2", 2, 0), row("3", None, 1), row("4", 3, 1), row("5", 0, 0)],
        schemas.PAPER_METADATA,
    )


@pytest.fixture(scope="module")
def positives(spark):
    return spark.createDataFrame(
        [("1", "", "t1", "a1", "2001"), ("", "7", "t2", "a2", "2002"), (None, None, "t3", "a3", "2003"),
         ("4", "8", "t4", "a4", "2004"), ("9", None, "t5", "a5", "2005")],
        schemas.POSITIVES,
    )


def test_label_diff(metadata, positives):
    assert rows(labels.label_diff(metadata, positives), "change", "id") == [
        ("conflict", "2"), ("dropped", "2"), ("dropped", "3"), ("dropped", "5"),
        ("new", "7"), ("new", "8"), ("new", "9"),
    ]


def test_refresh(spark, metadata, positives):
    refreshed = labels.refresh_metadata(metadata, positives)
    # Row four names an old id and a new one: it is added under the old id.
    assert rows(refreshed, "ID", "PY", "Usable", "Binary") == [
        ("1", "2000", 1, 1), ("2", "2000", 2, 1), ("3", "2000", None, 0), ("4", "2000", 3, 1),
        ("4", "2004", -1, 1), ("5", "2000", 0, 0), ("7", "2002", -1, 1), ("9", "2005", -1, 1),
    ]
    old = spark.createDataFrame([("x", 1, "iGEM", 1), ("c", 2, "crawler", 0)], schemas.PAPER_LABELS)
    table = labels.refresh_labels(refreshed, old)
    assert rows(table.where("Dataset = 'crawler'")) == [("c", "2", "crawler", 0)]
    assert table.where("Dataset = 'iGEM'").count() == 8


def test_labeled_examples(spark):
    own = spark.createDataFrame([("A-1", "T one"), ("A-2", None)], "id string, text string")
    crawled = spark.createDataFrame([("b 1", "Two*"), ("B-1", "not cleaned")], "id string, text string")
    marks = spark.createDataFrame(
        [("a/1", 2001, "x", 1), ("a!2", 2002, "x", 0), ("B.1", 2003, "x", 1), ("b 1", 2004, "x", 0)],
        schemas.PAPER_LABELS,
    )
    assert rows(labels.labeled_examples(own, crawled, marks)) == [
        ("a 1", 2001, '"t one"', 1), ("a 2", 2002, '"nan"', 0),
        ("b 1", 2003, '"two"', 1), ("b 1", 2004, '"two"', 0),
    ]


def test_balanced_examples(spark):
    figures = [(f"p{i}", f"text {i}", "1") for i in range(12)]
    empty = spark.createDataFrame([], schemas.FIGURES)
    crawled = spark.createDataFrame(figures, schemas.FIGURES)
    marks = (
        [(f"p{i}", 2000, 1, "1") for i in range(3)]  # positive
        + [("p3", 2000, 1, "2"), ("p4", 2000, 1, None), ("p5", 2000, 1, "0")]  # never used
        + [(f"p{i}", 2000, 0, "0") for i in range(6, 12)]  # negative
    )
    table = spark.createDataFrame(marks, schemas.FIGURE_LABELS)
    got = labels.balanced_examples(empty, crawled, table, key=["id"])
    assert sorted(r["id"] for r in got.where("label = 1").collect()) == ["p0", "p1", "p2"]
    assert got.where("label = 0").count() == 3
    # Negatives without a figure count towards the cut, then fall out.
    only_positive = crawled.where("paper_id < 'p3'")
    assert labels.balanced_examples(empty, only_positive, table, key=["id"]).where("label = 0").count() == 0


PREDICTIONS = [
    # paper, fig, text, label, pred, prob
    ("a", "1", "w", 1, 1, 0.9), ("a", "1", "w", 1, 1, 0.7), ("a", "2", "w", 1, 0, 0.1),
    ("b", "1", "w", 0, 1, 0.4), ("c", "1", "w", 0, 1, 0.5), ("c", "1", None, 0, 0, 0.5),
    (None, "1", "w", 1, 1, 1.0), ("d", None, "w", 1, 1, 1.0),
    ("e", "1", "w", 1, 1, 0.9), ("e", "2", "w", 1, 0, 0.2), ("e", "2", "w", 1, 0, 0.2), ("e", "2", "w", 1, 0, 0.2),
]


def test_rollups(spark):
    df = spark.createDataFrame(
        PREDICTIONS, "paper_id string, fig_id string, text string, label int, pred_y int, prob_y double"
    )
    figures = rollup.figure_rollup(df)
    assert rows(figures, "paper_id", "fig_id", "n_texts", "fig_pred", "take") == [
        ("a", "1", 2, True, False), ("a", "2", 1, False, False), ("b", "1", 1, False, True),
        ("c", "1", 1, False, False), ("e", "1", 1, True, True), ("e", "2", 3, False, False),
    ]
    observed = {r["paper_id"]: r for r in rollup.doc_rollup(figures).collect()}
    # Mean over figures, not over rows: e is (0.9 + 0.2) / 2.
    assert {p: round(r["prob_y"], 6) for p, r in observed.items()} == {"a": 0.45, "b": 0.4, "c": 0.5, "e": 0.55}
    assert {p: r["doc_pred"] for p, r in observed.items()} == {"a": 0, "b": 0, "c": 0, "e": 1}
    intended = {r["paper_id"]: r["doc_pred"] for r in rollup.doc_rollup(figures, "intended").collect()}
    assert intended == {"a": 1, "b": 1, "c": 0, "e": 1}
    assert rows(rollup.positive_docs(rollup.doc_rollup(figures)), "paper_id") == [("e",)]
    shuffled = rollup.doc_rollup(rollup.figure_rollup(df.orderBy(F.rand(3))))
    assert rows(shuffled, "paper_id", "doc_pred") == rows(rollup.doc_rollup(figures), "paper_id", "doc_pred")


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 4 + [(0, 1)] * 2, "label int, pred_y int")
    got = {r["metric"]: r["value"] for r in rollup.eval_metrics(df).collect()}
    assert (got["tp"], got["fn"], got["tn"], got["fp"]) == (3, 1, 4, 2)
    assert got["accuracy"] == 0.7 and got["sensitivity"] == 0.75
    assert round(got["specificity"], 6) == 0.666667 and round(got["f1"], 6) == 0.666667
    none = {r["metric"]: r["value"] for r in rollup.eval_metrics(df.where("label = 0")).collect()}
    assert none["sensitivity"] is None


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)], "label int")
    assert rows(rollup.class_weights(df), "label", "weight") == [(0, 2.0), (1, 4 / 6)]
    assert rows(rollup.add_class_weight(df).distinct()) == [(0, 2.0), (1, 4 / 6)]


def test_term_statistics(spark):
    df = spark.createDataFrame(
        [("tree tree node 12 the", 1), ("Tree, node!", 0), (None, 1), ("leaf", None)], "text string, label int"
    )
    assert [tuple(r) for r in stats.term_frequency(df, top=2).collect()] == [("tree", 3, 1.0), ("node", 2, 2 / 3)]
    assert rows(stats.category_terms(df, 2)) == [("node", 1, 1), ("tree", 2, 1)]


def test_term_scalers(spark):
    terms = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("c", 3, 0), ("d", 7, 0)], "term string, n_pos long, n_neg long")
    got = {r["term"]: r for r in stats.term_scalers(terms).collect()}
    assert [got[t]["dense_pos"] for t in "abcd"] == [0.0, 0.0, 0.5, 1.0]
    # Average ranks 1.5, 1.5, 3, 4.
    assert [round(got[t]["percentile_pos"], 6) for t in "abcd"] == [0.0, 0.0, 0.6, 1.0]
    assert [got[t]["log_standard_pos"] for t in "abcd"] == [0.0, 0.0, 0.5, 1.0]
    assert {got[t]["dense_neg"] for t in "abcd"} == {0.0}


def test_year_histogram(spark):
    years = ["1999"] * 2 + ["2000"] * 3 + ["2001"] * 5 + ["2002"] * 7 + ["2015.0", None]
    df = spark.createDataFrame([(str(i), y) for i, y in enumerate(years)], "id string, year string")
    got = {r["label"]: (r["n"], r["total"], r["share"]) for r in stats.year_histogram(df, 2, 3).collect()}
    assert got == {"earlier": (5, 17, 0.5), "2001": (5, 17, 0.5)}
    assert stats.year_histogram(df, 0, 2).where("label = 'earlier'").first()["n"] == 0


def test_rare_entities(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (10, "c"), (11, "d"), (1, None)], schemas.SPECIES)
    assert rows(stats.rare_entities(df, 1), "name") == [("a",)]
    assert rows(stats.rare_entities(df, 10), "name") == [("a",), ("b",), ("c",)]


def test_stage_audit(spark):
    texts = ["a" * 250, "a" * 250, "b" * 150, "c" * 50, None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    c = F.col("text")
    got = rollup.stage_audit(df, "text", F.length(c) > 100, F.length(c) > 200, c.startswith("a"))
    assert {r["stage"]: r["n"] for r in got.collect()} == {
        "read": 5, "downloaded": 3, "long_enough": 2, "distinct": 1, "relevant": 1,
    }


def test_a_third_of_the_rows_under_one_key(spark):
    """Hot ids go through the same plans and give whole results."""
    n = 3000
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id")))
    files = spark.range(n).select(
        hot.alias("id"), F.format_string("p/%05d", "id").alias("path"), F.lit(LONG).alias("text")
    )
    metadata = files.select(F.col("id").alias("ID")).distinct()
    assert joins.ingest_exact(files, metadata).count() == 2001
    assert joins.ingest_exact(files, metadata, first_file_only=False).count() == n
    assert joins.orphans(files, metadata.where("ID <> 'hot'")).count() == n // 3
    first = dedupe.first_per_key(files, ["id"], [F.col("path").desc()], row_id="path")
    assert first.where("id = 'hot'").first()["path"] == "p/02997" and first.count() == 2001
    figures = rollup.figure_rollup(
        files.select(
            F.col("id").alias("paper_id"), F.lit("1").alias("fig_id"), "text", F.lit(1).alias("label"),
            F.lit(1).alias("pred_y"), F.lit(0.75).alias("prob_y"),
        )
    )
    assert figures.where("paper_id = 'hot'").first()["n_texts"] == n // 3
    terms = files.select(F.concat_ws(" ", "id", F.lit("tree")).alias("text"), F.lit(1).alias("label"))
    assert rows(stats.category_terms(terms, 10), "term", "n_pos") == [("hot", 1000), ("tree", 3000)]
