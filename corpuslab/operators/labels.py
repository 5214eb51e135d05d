"""Label tables: differences, refresh and training tables."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab import constants as K
from corpuslab.functions.text import clean_id, normalize_text
from corpuslab.operators.dedupe import non_empty_ids, union_all
from corpuslab.operators.joins import flag_members
from corpuslab.operators.sampling import exact_split, mark_first
from corpuslab.storage import materialize

POSITIVE_IDS = ("i_citation_id", "ref_id")


def _ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("ID").alias("id"))


def _usable() -> Column:
    return F.coalesce(F.col("Usable") > 1, F.lit(False))


def label_diff(metadata: DataFrame, positives: DataFrame) -> DataFrame:
    """(id, change): 'new', 'dropped' and 'conflict' ids.

    Dropped ids are in the metadata but no longer among the positives; those a
    person marked usable are conflicts as well.
    """
    current = non_empty_ids(positives, *POSITIVE_IDS)
    known = _ids(metadata)
    new = current.subtract(known)
    dropped = known.subtract(current)
    conflict = _ids(metadata.where(_usable())).subtract(current)

    def tagged(df: DataFrame, change: str) -> DataFrame:
        return df.select("id", F.lit(change).alias("change"))

    return union_all(tagged(new, "new"), tagged(dropped, "dropped"), tagged(conflict, "conflict"))


def _rows_with_any(df: DataFrame, columns: Sequence[str], ids: DataFrame) -> DataFrame:
    """Rows where any of the columns is among the ids; a row comes once.

    Split into disjoint parts so that empty ids never act as a join key.
    """
    parts, rest = [], df
    for column in columns:
        present = (F.col(column).isNotNull()) & (F.col(column) != "")
        key = ids.select(F.col("id").alias(column))
        having = rest.where(present)
        parts.append(having.join(key, column, "left_semi"))
        rest = rest.where(~F.coalesce(present, F.lit(False))).unionByName(
            having.join(key, column, "left_anti")
        )
    return union_all(*parts)


def refresh_metadata(metadata: DataFrame, positives: DataFrame) -> DataFrame:
    """Metadata with Binary recomputed, followed by rows for the new positives."""
    positives = positives.na.fill("")
    current = non_empty_ids(positives, *POSITIVE_IDS)
    new = current.join(_ids(metadata).distinct(), "id", "left_anti")
    unlabelled = [c for c in K.METADATA_COLUMNS if c == "Usable" or c.startswith("Good_figure")]
    added = _rows_with_any(positives, POSITIVE_IDS, new).select(
        F.coalesce(F.nullif(F.col(POSITIVE_IDS[0]), F.lit("")), F.col(POSITIVE_IDS[1])).alias("ID"),
        F.col("c_first_author_lname").alias("AU"),
        F.col("c_title").alias("TI"),
        F.lit("").alias("JO"),
        F.col("i_year").alias("PY"),
        *[F.lit(K.UNLABELLED).alias(c) for c in unlabelled],
        F.lit(1).alias("Binary"),
    )
    kept = (
        flag_members(metadata.drop("Binary"), "ID", current, "_positive")
        .withColumn("Binary", (F.col("_positive") | _usable()).cast("int"))
        .drop("_positive")
        .withColumn("PY", F.col("PY").cast("string"))
    )
    return kept.select(*K.METADATA_COLUMNS).unionByName(added.select(*K.METADATA_COLUMNS))


def refresh_labels(
    refreshed: DataFrame, old_labels: DataFrame, own: str = "iGEM", keep: str = "crawler"
) -> DataFrame:
    """Label table: own rows from the refreshed metadata, ``keep`` rows as before."""
    own_rows = refreshed.select("ID", "PY", F.lit(own).alias("Dataset"), "Binary")
    kept = old_labels.where(F.col("Dataset") == keep).withColumn("PY", F.col("PY").cast("string"))
    return union_all(own_rows, kept)


def labeled_examples(
    own_texts: DataFrame, crawled_texts: DataFrame, labels: DataFrame
) -> DataFrame:
    """(id, year, text, label): texts(id, text) joined to labels(ID, PY, Binary).

    Own ids and label ids are cleaned; crawled ids already are.
    """
    texts = union_all(
        own_texts.select(clean_id(F.col("id")).alias("id"), "text"), crawled_texts.select("id", "text")
    )
    marks = labels.select(clean_id(F.col("ID")).alias("id"), "PY", "Binary")
    return texts.join(marks, "id").select(
        "id",
        F.col("PY").alias("year"),
        normalize_text(F.col("text")).alias("text"),
        F.col("Binary").alias("label"),
    )


def paper_training_table(
    own_texts: DataFrame, crawled_texts: DataFrame, labels: DataFrame,
    key: Sequence[str] | None = None, seed: int = 42,
) -> DataFrame:
    # Written once: the steps that find the cut read the keys alone.
    examples = materialize(labeled_examples(own_texts, crawled_texts, labels), "examples")
    return exact_split(examples, key, seed=seed)


def balanced_examples(
    own_figures: DataFrame,
    crawled_figures: DataFrame,
    labels: DataFrame,
    key: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """(id, year, text, label, fig_id): as many negatives as positives.

    Positives are figures named by their label; negatives figures of papers
    without one. The negatives are cut to the number of positives before rows
    without a text are removed.
    """
    figures = union_all(
        own_figures.select(clean_id(F.col("paper_id")).alias("id"), "text", "fig_id"),
        crawled_figures.select(F.col("paper_id").alias("id"), "text", "fig_id"),
    )
    marks = labels.select(clean_id(F.col("ID")).alias("id"), "PY", "Binary", "Time_F")
    joined = figures.join(marks, "id", "right").select(
        "id", F.col("PY").alias("year"), "text", F.col("Binary").alias("label"), "fig_id", "Time_F"
    )
    joined = materialize(joined, "figure-examples")
    positive = (F.col("Time_F") != "0") & (F.col("Time_F") == F.col("fig_id"))
    negative = (F.col("Time_F") == "0") & (F.col("label") == 0)
    wanted = joined.where(positive).count()
    marked = mark_first(joined, lambda n: wanted, key, seed, "_kept", among=negative)
    return (
        marked.where((positive | F.col("_kept")) & F.col("text").isNotNull())
        .drop("Time_F", "_kept")
        .withColumn("text", normalize_text(F.col("text")))
    )


def figure_training_table(
    own_figures: DataFrame, crawled_figures: DataFrame, labels: DataFrame,
    key: Sequence[str] | None = None, seed: int = 42,
) -> DataFrame:
    # Another seed: the negatives kept are the first in the order of ``seed``.
    balanced = balanced_examples(own_figures, crawled_figures, labels, key, seed)
    return exact_split(balanced, key, seed=seed + 1)
