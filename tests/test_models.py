import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from corpuslab.operators import features as feats
from corpuslab.operators.models import FAMILIES, fit
from corpuslab.plans import scoring, training
from corpuslab.sources import tables
from corpuslab.storage import checkpoint

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SMALL = {
    "lr": {}, "l1": {"alpha": 1e-3}, "dt": {"impurity_decrease": 1e-4}, "rf": {"impurity_decrease": 1e-4, "n_trees": 10},
    "knn": {"n_neighbors": 3}, "svm": {"C": 1.0, "kernel": "linear"}, "ada": {"n_estimators": 5},
    "gb": {"n_estimators": 5}, "bag": {"n_estimators": 5},
}


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        label = int(i % 3 == 0)
        x = rng.normal(1.2 * label, 0.6, 4)
        rows.append((i, [float(v) for v in x], label))
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    table = checkpoint(df.select("id", array_to_vector("x").alias("features"), "label").coalesce(1))
    return table.where("id < 200"), table.where("id >= 200")


@pytest.mark.parametrize("family", FAMILIES)
def test_family_beats_the_majority(examples, family):
    train, test = examples
    predicted = fit(family, train, **SMALL[family]).predict(test)
    rows = predicted.select("id", "pred_y", "prob_y", "features").collect()
    assert len(rows) == test.count()
    assert all(r["pred_y"] in (0, 1) and 0.0 <= r["prob_y"] <= 1.0 for r in rows)
    assert training.f1_of(predicted) > 0.7
    if family == "svm":  # its many small jobs make a second fit slow
        return
    again = fit(family, train, **SMALL[family]).predict(test).select("id", "pred_y", "prob_y", "features").collect()
    assert {r["id"]: r["pred_y"] for r in rows} == {r["id"]: r["pred_y"] for r in again}


@pytest.mark.parametrize("kernel", ["poly", "rbf", "sigmoid"])
def test_kernels(examples, kernel):
    train, test = examples
    predicted = fit("svm", train, C=1.0, kernel=kernel).predict(test)
    assert training.f1_of(predicted) > 0.4
    assert predicted.columns == ["id", "features", "label", "pred_y", "prob_y"]


def test_rbf_solves_a_ring(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        label = i % 2
        angle, radius = rng.uniform(0, 2 * np.pi), (0.5 if label else 2.0) + rng.normal(0, 0.1)
        rows.append((i, [float(radius * np.cos(angle)), float(radius * np.sin(angle))], label))
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    df = checkpoint(df.select("id", array_to_vector("x").alias("features"), "label").coalesce(1))
    assert training.f1_of(fit("svm", df, C=10.0, kernel="rbf").predict(df)) > 0.95


def test_boosting_lowers_the_training_error(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (300, 2))
    rows = [(i, [float(a), float(b)], int(a + b > 0)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    df = checkpoint(df.select("id", array_to_vector("x").alias("features"), "label").coalesce(1))
    one, many = (training.f1_of(fit("ada", df, n_estimators=n).predict(df)) for n in (1, 12))
    assert many > one + 0.05


def test_grid_search(examples):
    train, _ = examples
    search = training.grid_search("dt", train, [{"impurity_decrease": d} for d in (1.0, 1e-3, 1e-4)], holdout_rows=50)
    assert len(search.tried) == 3 and search.tried[0][1] == 0.0
    assert search.best_f1 == max(f for _, f in search.tried) and search.best.params["impurity_decrease"] == 1e-3
    hopeless = training.grid_search("dt", train, [{"impurity_decrease": 1.0}, {"impurity_decrease": 2.0}], 50)
    assert hopeless.best.params == {"impurity_decrease": 1.0}


def test_evaluate_keeps_predictions_and_model_numbers(spark, examples, tmp_path):
    train, test = examples
    out = training.evaluate(fit("dt", train, impurity_decrease=1e-4), test, "r", predictions_path=str(tmp_path / "p"))
    values = {(r["scope"], r["metric"]): r["value"] for r in out.collect()}
    assert values["model", "depth"] >= 1 and values["row", "f1"] > 0.7
    assert spark.read.parquet(str(tmp_path / "p")).count() == test.count()


def test_model_round_trip(spark, examples, tmp_path):
    train, test = examples
    fitted = fit("lr", train)
    tables.save_model(fitted.model.model, str(tmp_path / "m"))
    loaded = tables.load_model(LogisticRegressionModel, str(tmp_path / "m"))
    want = fitted.predict(test).select("id", "prob_y").collect()
    fitted.model.model = loaded
    assert sorted(fitted.predict(test).select("id", "prob_y").collect()) == sorted(want)


@pytest.fixture(scope="module")
def figure_table(spark):
    rows = []
    for i in range(120):
        label = i % 2
        words = "tree node age" if label else "map river soil"
        rows.append((i, f"p{i // 4}", f"{i % 2}", f"{words} common {i % 5} {'tree' if i % 7 == 0 else ''}", label))
    return spark.createDataFrame(rows, "id long, paper_id string, fig_id string, text string, label int")


def test_model_matrix(figure_table):
    train, test = figure_table.where("id < 80"), figure_table.where("id >= 80")
    table = training.Table("fig", train, test, figure_table, longest=3, figures=True)
    out = training.model_matrix(
        [table], {"l1": [{"alpha": 1e-3}]}, holdout_rows=20, vector_options={"size": 4, "passes": 1, "min_count": 1}
    )
    runs = {(r["run"], r["scope"]) for r in out.collect()}
    kinds = ("tfidf", "docvec", "corpus_tfidf", "corpus_docvec")
    assert runs == {(f"matrix/fig/{k}", s) for k in kinds for s in ("row", "figure", "paper", "model")}
    f1 = out.where("run = 'matrix/fig/tfidf' and scope = 'row' and metric = 'f1'").first()["value"]
    assert f1 > 0.9


def test_score_sample(figure_table, tmp_path):
    model = feats.fit_tfidf_vectors(figure_table)
    model.write().overwrite().save(str(tmp_path / "tfidf"))
    loaded = PipelineModel.load(str(tmp_path / "tfidf"))
    fitted = fit("lr", checkpoint(feats.apply_tfidf_vectors(loaded, figure_table)))
    corpus = figure_table.unionByName(figure_table)
    scored = scoring.score_sample(
        corpus, lambda d: feats.apply_tfidf_vectors(loaded, d), fitted, share=0.25, key=["id"]
    )
    assert scored.count() == 30 and scored.select("id").distinct().count() == 30


def word_scorer():
    def predict(texts):
        return np.array([[0.0, 5.0 if "tree" in t else -5.0] for t in texts])

    return predict


def test_score_logits(figure_table):
    scored = scoring.score_logits(figure_table, ["text"], word_scorer, batch_size=7)
    assert scored.where("(pred_y = 1) <> contains(text, 'tree')").count() == 0
    shares = scoring.share_of_positive_papers(scored.withColumn("source", F.lit("s")))
    assert shares.first()["n"] == 30
    assert scoring.positive_papers(scored).columns == ["paper_id", "prob_y", "doc_pred"]
