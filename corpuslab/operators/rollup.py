"""Window predictions rolled up to figures and papers, and evaluation metrics."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def figure_rollup(predictions: DataFrame, with_label: bool = True) -> DataFrame:
    """One row per (paper_id, fig_id); rows with a missing key are left out."""
    means = {"mean_pred": F.avg("pred_y"), "mean_prob": F.avg("prob_y")}
    if with_label:
        means["mean_label"] = F.avg("label")
    figures = (
        predictions.where("paper_id is not null and fig_id is not null")
        .groupBy("paper_id", "fig_id")
        .agg(*[c.alias(n) for n, c in means.items()], F.count("text").alias("n_texts"))
    )
    voted = F.col("mean_pred") > 0.5
    return figures.withColumns(
        {
            "fig_pred": voted & (F.col("mean_prob") > 0.5),
            "take": voted & (F.col("n_texts") == 1),
        }
    )


def doc_rollup(figures: DataFrame, mode: str = "observed", with_label: bool = True) -> DataFrame:
    """One row per paper from ``figure_rollup`` output.

    ``prob_y`` is the unweighted mean over figures. ``observed``: a paper is
    positive if that mean exceeds one half. ``intended``: also if any figure is
    positive or any single-window figure was voted positive.
    """
    if mode not in ("observed", "intended"):
        raise ValueError(f"unknown mode {mode!r}")
    parts = [
        F.max("fig_pred").alias("any_fig"),
        F.max("take").alias("any_take"),
        F.avg("mean_prob").alias("prob_y"),
    ]
    if with_label:
        parts.append(F.avg("mean_label").alias("label"))
    papers = figures.groupBy("paper_id").agg(*parts)
    positive = F.col("prob_y") > 0.5
    if mode == "intended":
        positive = positive | F.col("any_fig") | F.col("any_take")
    return papers.select(
        "paper_id",
        F.col("any_fig").cast("int").alias("fig_pred"),
        F.col("any_take").cast("int").alias("take"),
        "prob_y",
        positive.cast("int").alias("doc_pred"),
        *(["label"] if with_label else []),
    )


def positive_docs(papers: DataFrame) -> DataFrame:
    return papers.where("doc_pred = 1").select("paper_id", "prob_y", "doc_pred")


def positive_share(predictions: DataFrame, by: str = "source", pred: str = "pred_y") -> DataFrame:
    return predictions.groupBy(by).agg(
        F.avg(pred).alias("share"), F.count(F.lit(1)).alias("n")
    )


def eval_metrics(df: DataFrame, label: str = "label", pred: str = "pred_y", by: tuple = ()) -> DataFrame:
    """(metric, value) rows; class 1 is positive; a zero denominator is NULL.

    ``n_other`` counts the rows whose label or prediction is neither 0 nor 1: no other
    metric has a place for them.
    """

    def cell(truth: int, guess: int) -> Column:
        return F.count_if((F.col(label) == truth) & (F.col(pred) == guess))

    counts = df.groupBy(*by).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"),
        F.count_if(~F.coalesce(F.col(label).isin(0, 1) & F.col(pred).isin(0, 1), F.lit(False))).alias("n_other"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    values = {
        "tp": tp,
        "fp": fp,
        "fn": fn,
        "tn": tn,
        "n_other": F.col("n_other"),
        "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn),
        "sensitivity": F.try_divide(tp, tp + fn),
        "specificity": F.try_divide(tn, tn + fp),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
    }
    pairs = F.array(
        *[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values.items()]
    )
    return counts.select(*by, F.explode(pairs).alias("m")).select(*by, "m.metric", "m.value")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): n_rows / (n_classes * n), rows with a label only."""
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = Window.partitionBy(F.lit(0))  # one row per class
    weight = F.sum("n").over(classes) / (F.count("n").over(classes) * F.col("n"))
    return per_class.withColumn("weight", weight)


def add_class_weight(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """Weight column from a handful of class counts; a projection, because a join
    on the label would send each class to one task."""
    value = F.lit(None).cast("double")
    for row in class_weights(df, label).collect():
        value = F.when(F.col(label) == row[label], F.lit(row["weight"])).otherwise(value)
    return df.withColumn(weight, value)


def stage_audit(corpus: DataFrame, text: str, downloaded: Column, long: Column, relevant: Column) -> DataFrame:
    """Row counts after each cleaning stage, as (stage, n)."""
    before = corpus.agg(
        F.count(F.lit(1)).alias("read"), F.count_if(downloaded).alias("downloaded"),
        F.count_if(long).alias("long_enough"),
    )
    after = corpus.where(long).dropDuplicates().agg(
        F.count(F.lit(1)).alias("distinct"), F.count_if(relevant).alias("relevant")
    )

    def rows(df: DataFrame) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("stage"), F.col(c).alias("n")) for c in df.columns]
        return df.select(F.explode(F.array(*pairs)).alias("r")).select("r.stage", "r.n")

    return rows(before).unionByName(rows(after))
