"""Scoring of unlabelled corpora, with vector models or a plugged-in scorer."""
from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from corpuslab import constants as K
from corpuslab.functions.scores import positive_probability, predicted_class
from corpuslab.operators.rollup import doc_rollup, figure_rollup, positive_docs, positive_share
from corpuslab.operators.sampling import sample_share
from corpuslab.storage import materialize


def score_sample(
    corpus: DataFrame,
    featurize: Callable[[DataFrame], DataFrame],
    fitted,
    share: float = K.SAMPLE_SHARE,
    key: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Distinct rows, an exact share of them, then pred_y and prob_y.

    Exactly the sampled rows are scored.
    """
    sample = sample_share(materialize(corpus.dropDuplicates(), "distinct-corpus"), key, share, seed)
    return fitted.predict(featurize(sample)).drop("features")


def score_logits(
    df: DataFrame, inputs: list[str], make_predict_fn: Callable, batch_size: int = K.SCORING_BATCH,
    input_shapes: list | None = None,
) -> DataFrame:
    """Add pred_y and prob_y from a two-logit scorer, run in Arrow batches.

    ``make_predict_fn`` loads the scorer once per Python worker. Keys stay in the
    row, so no positional join is needed afterwards.
    """
    scorer = predict_batch_udf(
        make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size,
        input_tensor_shapes=input_shapes,
    )
    scored = df.withColumn("_logits", scorer(*inputs))
    return scored.withColumns(
        {"pred_y": predicted_class(F.col("_logits")), "prob_y": positive_probability(F.col("_logits"))}
    ).drop("_logits")


def papers_from_figures(predictions: DataFrame, mode: str = "observed") -> DataFrame:
    """Paper predictions of an unlabelled figure corpus."""
    return doc_rollup(figure_rollup(predictions, with_label=False), mode, with_label=False)


def positive_papers(predictions: DataFrame, mode: str = "observed") -> DataFrame:
    return positive_docs(papers_from_figures(predictions, mode))


def share_of_positive_papers(predictions: DataFrame, source: str = "source", mode: str = "observed") -> DataFrame:
    """(source, share, n) over papers; a paper belongs to one source."""
    papers = papers_from_figures(predictions, mode)
    origin = predictions.groupBy("paper_id").agg(F.min(source).alias(source))
    return positive_share(papers.join(origin, "paper_id"), by=source, pred="doc_pred")
