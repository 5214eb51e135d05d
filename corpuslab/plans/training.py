"""Grid search, model matrix and scoring of test tables."""
import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool
from threading import Lock
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab import constants as K
from corpuslab.operators import doc_vectors as vectors
from corpuslab.operators import features as feats
from corpuslab.operators.models import Fitted, cut_tree, fit
from corpuslab.operators.rollup import doc_rollup, eval_metrics, figure_rollup
from corpuslab.operators.sampling import holdout
from corpuslab.operators.trees import Nodes, fit_full_tree
from corpuslab.schemas import METRICS
from corpuslab.storage import checkpoint, exists, write_once

# Longest n-gram of the TF-IDF features that are fit on a corpus.
CORPUS_GRAMS = 2

# Full grids; pass smaller ones for quick runs.
GRIDS = {
    "lr": [{}],
    "l1": [{"alpha": a} for a in K.L1_ALPHAS],
    "dt": [{"impurity_decrease": d} for d in K.IMPURITY_DECREASES],
    "rf": [{"impurity_decrease": d} for d in K.IMPURITY_DECREASES],
    "knn": [{"n_neighbors": n} for n in K.NEIGHBOUR_COUNTS],
    "svm": [{"C": c, "kernel": k} for c, k in product(K.SVM_COSTS, K.SVM_KERNELS)],
    "ada": [{"n_estimators": n} for n in K.ENSEMBLE_SIZES],
    "gb": [{"n_estimators": n} for n in K.ENSEMBLE_SIZES],
    "bag": [{"n_estimators": n} for n in K.ENSEMBLE_SIZES],
}


def training_table(df: DataFrame) -> DataFrame:
    """Written rows in even partitions, for the many passes of a fit.

    The partition count is left to the adaptive planner: enough for a large table,
    one or two for a small one, whose iterations would otherwise be all overhead.
    """
    return checkpoint(df.repartition("id"))


@dataclass
class Search:
    best: Fitted
    best_f1: float
    tried: list[tuple[dict, float]]


class Ledger:
    """What has been finished, as one small file per candidate or cell below ``path``.

    A run that was lost starts again with the same ledger and does only what is missing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _file(self, key: list) -> str:
        return f"{self.path}/{hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()}"

    def get(self, key: list) -> Any:
        """The value of a finished key, else None."""
        path = self._file(key)
        if not exists(self.spark, path):
            return None
        return json.loads(self.spark.read.text(path).first()["value"])["value"]

    def put(self, key: list, value: Any) -> None:
        write_once(self.spark, self._file(key), json.dumps({"key": key, "value": value}))


def f1_of(predicted: DataFrame) -> float:
    row = eval_metrics(predicted).where("metric = 'f1'").first()
    return row["value"] if row and row["value"] is not None else 0.0


def grid_search(
    family: str,
    examples: DataFrame,
    grid: Iterable[dict] | None = None,
    holdout_rows: int = K.HOLDOUT_ROWS,
    seed: int = 0,
    parallelism: int = 4,
    ledger: Ledger | None = None,
    name: str = "",
) -> Search:
    """Best candidate by F1 of class 1 on one fixed hold-out, several at a time.

    The first of equals wins; the first candidate is the fallback if no F1 is above zero. With a
    ``ledger``, candidates that it has under ``name`` (features and table) are not fitted again,
    but for the best one, if this run has not fitted it. All trees of a grid share one fit.
    """
    split = holdout(examples, ["id"], holdout_rows, seed)
    table = training_table(split.select("id", "features", "label", "split"))
    train = table.where("split = 'train'").drop("split")
    cv = table.where("split = 'cv'").drop("split")
    full: dict[int, Nodes] = {}

    def fit_one(params: dict) -> Fitted:
        if family != "dt":
            return fit(family, train, seed, **params)
        depth = params.get("max_depth", 30)
        with growing:
            if depth not in full:
                full[depth] = fit_full_tree(train, seed, depth)
        return cut_tree(full[depth], params)

    growing = Lock()

    def try_one(params: dict) -> tuple[Fitted | None, float]:
        key = [name, family, params, holdout_rows, seed]
        known = ledger.get(key) if ledger else None
        if known is not None:
            return None, known
        candidate = fit_one(params)
        f1 = f1_of(candidate.predict(cv))
        if ledger:
            ledger.put(key, f1)
        return candidate, f1

    candidates = list(GRIDS[family] if grid is None else grid)
    with ThreadPool(parallelism) as pool:
        results = pool.map(inheritable_thread_target(examples.sparkSession)(try_one), candidates, chunksize=1)
    best, best_f1 = 0, 0.0
    for k, (_, f1) in enumerate(results):
        if f1 > best_f1:
            best, best_f1 = k, f1
    fitted = results[best][0] or fit_one(candidates[best])
    return Search(fitted, best_f1, [(p, f1) for p, (_, f1) in zip(candidates, results)])


def metrics_log(df: DataFrame, run: str, model: str, scope: str) -> DataFrame:
    """Rows of the metrics table from an ``eval_metrics`` result."""
    return df.select(
        F.lit(run).alias("run"), F.lit(model).alias("model"), F.lit(scope).alias("scope"), "metric", "value"
    )


def evaluate(
    fitted: Fitted, test: DataFrame, run: str, with_docs: bool = False, mode: str = "observed",
    predictions_path: str | None = None,
) -> DataFrame:
    """(run, model, scope, metric, value) on rows and, for figure tables, on
    figures and papers too; the model's own numbers have scope 'model'.

    The predictions are written to ``predictions_path``, or to scratch storage.
    """
    predicted = fitted.predict(test).drop("features")
    if predictions_path:
        predicted.write.mode("overwrite").parquet(predictions_path)
        predicted = test.sparkSession.read.parquet(predictions_path)
    else:
        predicted = checkpoint(predicted)
    out = metrics_log(eval_metrics(predicted), run, fitted.family, "row")
    if fitted.notes:
        notes = [(run, fitted.family, "model", name, value) for name, value in fitted.notes.items()]
        out = out.unionByName(test.sparkSession.createDataFrame(notes, METRICS))
    if with_docs:
        figures = figure_rollup(predicted)
        as_flag = figures.select(
            F.col("mean_label").alias("label"), F.col("fig_pred").cast("int").alias("pred_y")
        )
        papers = doc_rollup(figures, mode).withColumn("pred_y", F.col("doc_pred"))
        out = out.unionByName(metrics_log(eval_metrics(as_flag), run, fitted.family, "figure"))
        out = out.unionByName(metrics_log(eval_metrics(papers), run, fitted.family, "paper"))
    return out


def classifier_splits(
    train: DataFrame, test: DataFrame, holdout_rows: int = K.HOLDOUT_ROWS, key: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """(text, label, split): 'cv' is cut from the training rows, which lose it."""
    cut = holdout(train, key, holdout_rows, seed).select("text", "label", "split")
    return cut.unionByName(test.select("text", "label", F.lit("test").alias("split")))


# --- feature kinds x tables ---------------------------------------------------


def tfidf_features(own: DataFrame, other: DataFrame | None, longest: int) -> Callable[[DataFrame], DataFrame]:
    """Fit on the training texts, or on a corpus if one is given."""
    model = feats.fit_tfidf_vectors(own if other is None else other, longest=longest)
    return lambda df: feats.apply_tfidf_vectors(model, df, longest=longest)


def doc_vector_features(own: DataFrame, other: DataFrame | None, **options) -> Callable[[DataFrame], DataFrame]:
    model = vectors.fit_doc_vectors(own if other is None else other, **options)
    return lambda df: vectors.apply_doc_vectors(model, df)


@dataclass
class Table:
    """A training table with its unlabelled corpus. ``longest`` is the n-gram length."""

    name: str
    train: DataFrame
    test: DataFrame
    corpus: DataFrame
    longest: int
    figures: bool


def model_matrix(
    tables: list[Table],
    families: dict[str, list[dict]] | None = None,
    run: str = "matrix",
    holdout_rows: int = K.HOLDOUT_ROWS,
    vector_options: dict | None = None,
    ledger: Ledger | None = None,
) -> DataFrame:
    """Metrics of the best model of each family for four feature kinds per table:
    TF-IDF and document vectors, each fit on the training texts or the corpus.

    With a ``ledger``, a cell's family that it has is not trained again."""
    options = vector_options or {}
    wanted = families or {f: GRIDS[f] for f in GRIDS if f != "lr"}
    rows: list[list] = []
    for from_corpus, kind, table in product((False, True), ("tfidf", "docvec"), tables):
        name = f"{run}/{table.name}/{'corpus_' if from_corpus else ''}{kind}"
        keys = {family: ["cell", name, family, grid, holdout_rows, options if kind == "docvec" else {}] for family, grid in wanted.items()}
        known = {family: ledger.get(key) if ledger else None for family, key in keys.items()}
        if any(found is None for found in known.values()):
            other = table.corpus if from_corpus else None
            # Corpus TF-IDF always uses the default gram length.
            longest = CORPUS_GRAMS if from_corpus else table.longest
            if kind == "tfidf":
                apply = tfidf_features(table.train, other, longest)
            else:
                apply = doc_vector_features(table.train, other, **options)
            train, test = training_table(apply(table.train)), training_table(apply(table.test))
        for family, grid in wanted.items():
            if known[family] is None:
                search = grid_search(family, train, grid, holdout_rows, ledger=ledger, name=name)
                found = evaluate(search.best, test, name, with_docs=table.figures).select(METRICS.fieldNames()).collect()
                known[family] = [list(r) for r in found]  # a few dozen numbers
                if ledger:
                    ledger.put(keys[family], known[family])
            rows += known[family]
    return tables[0].train.sparkSession.createDataFrame([tuple(r) for r in rows], METRICS)
