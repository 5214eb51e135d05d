"""Vocabulary and TF-IDF.

Texts are tokenised by Spark, once, into a written table. Tasks then number the words of a batch
and count grams as numbers, several documents at a time.

A vocabulary first counts the words, then bounds the grams of the frequent words alone (no gram is
in more documents than each of its words), and then counts these. To bound grams, each task keeps a summary of
those that many of its documents hold: beyond ``capacity`` grams, all counts are lowered and the
smallest fall out (Misra and Gries). Summaries merge by addition, and a gram's true count exceeds
its merged one by no more than all tasks have taken off, so grams that reach the wanted share with
that allowance are a superset of the frequent ones. The last pass counts these exactly. If the
allowance itself comes near the wanted count, a pass is repeated with a larger capacity.
"""
from collections import Counter
from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab import constants as K
from corpuslab.functions.text import normalize_text
from corpuslab.functions.tokens import feature_words
from corpuslab.storage import materialize

#: Tokens whose grams a task numbers at a time (one document may have more).
SLICE_TOKENS = 250_000

#: Grams in a task's summary; it bounds memory, not results.
CAPACITY = 200_000

#: Terms of a vocabulary that tasks hold in memory at most; a larger one needs a larger minimum share.
MOST_TERMS = 1_000_000


def _tokens(text: str) -> Column:
    """Feature words of the normalised text; none for a null text."""
    return F.coalesce(feature_words(normalize_text(F.col(text))), F.array().cast("array<string>"))


def token_table(df: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """Written table of ``columns`` and the tokens of the text, for several passes."""
    return materialize(df.select(*columns, _tokens(text).alias("tokens")), "tokens")


def _slices(batch: pa.RecordBatch, column: int = 0) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``SLICE_TOKENS`` tokens."""
    ends = np.cumsum(np.diff(batch.column(column).offsets.to_numpy()))
    start = done = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_TOKENS, "right")))
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def _counted(lists: pa.Array, longest: int, known: Collection[str] | None = None):
    """For 1..longest: (grams, then per document and gram: document, number of the gram, times).

    Grams with a word outside ``known`` are left out, if it is given."""
    coded = lists.flatten().dictionary_encode()
    names, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    bounds = lists.offsets.to_numpy()
    docs = np.repeat(np.arange(len(lists)), np.diff(bounds))
    usable = np.ones(len(ids), bool) if known is None else np.fromiter((w in known for w in names), bool, len(names))[ids]
    grams, number, whole = names, ids, usable
    for n in range(1, longest + 1):
        if n > 1:
            # A gram is the number of the gram before its last word, and that word.
            whole = whole[:-1] & usable[n - 1 :] & (docs[n - 1 :] == docs[: len(docs) - n + 1])
            pairs, found = np.unique((number[:-1] * len(names) + ids[n - 1 :])[whole], return_inverse=True)
            grams = [f"{grams[a]} {names[b]}" for a, b in zip((pairs // len(names)).tolist(), (pairs % len(names)).tolist())]
            number = np.zeros(len(whole), np.int64)
            number[whole] = found
        if not grams or not len(whole):
            return
        cells, times = np.unique((docs[: len(whole)] * len(grams) + number)[whole], return_counts=True)
        yield grams, cells // len(grams), cells % len(grams), times


def _summaries(tokens: DataFrame, longest: int, capacity: int, words: Collection[str] | None = None) -> DataFrame:
    """(term, n): merged summaries of the numbers of documents; the row without a term has what was taken off."""
    shared = None if words is None else tokens.sparkSession.sparkContext.broadcast(words)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, taken = Counter(), 0
        known = None if shared is None else shared.value
        for part in (p for batch in batches for p in _slices(batch)):
            for grams, _, number, _ in _counted(part.column(0), longest, known):
                for k, n in zip(*np.unique(number, return_counts=True)):
                    counts[grams[k]] += int(n)
                if len(counts) > 2 * capacity:
                    lower = sorted(counts.values())[-capacity - 1]
                    counts = Counter({g: n - lower for g, n in counts.items() if n > lower})
                    taken += lower
        yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), taken], pa.int64())], ["term", "n"])

    found = tokens.select("tokens").mapInArrow(summarise, "term string, n long")
    return materialize(found.groupBy("term").agg(F.sum("n").alias("n")), "summaries")


def _candidates(tokens: DataFrame, longest: int, at_least: float, capacity: int) -> set[str]:
    """A superset of the grams in at least so many documents, bounded by the grams of a document over the minimum share."""
    found = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").count()
    words = _bounded(found.where(F.col("count") >= at_least), "term")
    if longest == 1:
        return words
    while True:
        merged = _summaries(tokens, longest, capacity, words)
        taken = merged.where("term is null").agg(F.sum("n")).first()[0] or 0
        if taken <= at_least / 2:
            kept = merged.where(F.col("term").isNotNull() & (F.col("n") + taken >= at_least))
            return _bounded(kept, "term")
        capacity *= 4


def _bounded(terms: DataFrame, *columns: str):
    """The terms for use in tasks: a set, or a dict if there are further columns."""
    rows = terms.select(*columns).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: raise the minimum share")
    return {r[0]: tuple(r[1:]) for r in rows} if len(columns) > 1 else {r[0] for r in rows}


def _words_in(terms: Collection[str]) -> set[str]:
    return {w for term in terms for w in term.split(" ")}


def _listed(lists: pa.ListArray, longest: int, terms: Collection[str], known: Collection[str]) -> pa.ListArray:
    """Per document: its grams among ``terms``, each as often as it occurs."""
    docs, found = [], []
    for grams, doc, number, times in _counted(lists, longest, known):
        inside = np.fromiter((g in terms for g in grams), bool, len(grams))[number]
        number = np.repeat(number[inside], times[inside])
        docs.append(np.repeat(doc[inside], times[inside]))
        found.append(pa.array(grams, pa.string()).take(pa.array(number)))
    doc = np.concatenate([np.empty(0, np.int64), *docs])
    order = np.argsort(doc, kind="stable")
    ends = np.cumsum(np.bincount(doc, minlength=len(lists)))
    flat = pa.concat_arrays([pa.array([], pa.string()), *found]).take(pa.array(order))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat)


def _grams(tokens: Column, longest: int, vocabulary: Sequence[str]) -> Column:
    """Grams of the tokens that are in the vocabulary. Words are cut once per text, and grams numbered a batch at a time:
    written as one Spark expression, each word of a gram would cut the whole text again."""
    terms = set(vocabulary)

    @F.arrow_udf("array<string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _words_in(terms)
        for lists in batches:
            whole = pa.RecordBatch.from_arrays([lists], ["tokens"])
            yield pa.concat_arrays([pa.array([], pa.list_(pa.string())), *(_listed(p.column(0), longest, terms, known) for p in _slices(whole))])

    return find(tokens)


def fit_vocabulary(
    corpus: DataFrame,
    text: str = "text",
    longest: int = 2,
    min_share: float = K.MIN_DOC_SHARE,
    max_share: float = K.MAX_DOC_SHARE,
    capacity: int = CAPACITY,
) -> DataFrame:
    """(term, df, idf) of the terms in min_share..max_share of the documents.

    ``corpus`` is a table with texts, or a ``token_table``. This is the fitted vectorizer: it is
    written to shared storage. Its size is bounded by (distinct terms per document) / min_share.
    """
    tokens = corpus if "tokens" in corpus.columns else token_table(corpus, text=text)
    n = tokens.count()
    low, high = min_share * n, max_share * n
    spark = tokens.sparkSession
    wanted = spark.sparkContext.broadcast(_candidates(tokens, longest, low, capacity))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = wanted.value, Counter()
        known = _words_in(terms)
        for part in (p for batch in batches for p in _slices(batch)):
            for grams, _, number, _ in _counted(part.column(0), longest, known):
                for k, times in zip(*np.unique(number, return_counts=True)):
                    if grams[k] in terms:
                        counts[grams[k]] += int(times)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    exact = tokens.select("tokens").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
    kept = exact.where((F.col("df") >= low) & (F.col("df") <= high))
    idf = F.log(F.lit(1.0 + n) / (F.col("df") + 1.0)) + 1.0
    return materialize(kept.withColumn("idf", idf), "vocabulary")


def tfidf(
    docs: DataFrame, vocabulary: DataFrame, key: str = "id", text: str = "text", longest: int = 2
) -> DataFrame:
    """(key, term, tf, weight) with unit length per document, counted and scaled inside the row: no shuffle.

    ``docs`` is a table with texts, or a ``token_table`` with the key."""
    tokens = docs.select(key, "tokens") if "tokens" in docs.columns else docs.select(key, _tokens(text).alias("tokens"))
    terms = _bounded(vocabulary, "term", "idf")
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        known = _words_in(idf)
        for batch in (p for whole in batches for p in _slices(whole, 1)):
            parts, squares = [], np.zeros(batch.num_rows)
            for grams, doc, number, times in _counted(batch.column(1), longest, known):
                scale = np.array([idf.get(g, (0.0,))[0] for g in grams])[number]
                inside = scale > 0.0
                doc, times, raw = doc[inside], times[inside], (times * scale)[inside]
                np.add.at(squares, doc, raw * raw)
                parts.append((doc, pa.array(grams, pa.string()).take(pa.array(number[inside])), times, raw))
            for doc, names, times, raw in parts:
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(doc)), names, pa.array(times.astype(np.int64)), pa.array(raw / np.sqrt(squares[doc]))],
                    [key, "term", "tf", "weight"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.mapInArrow(weigh, f"`{key}` {kind}, term string, tf long, weight double")


# --- vector form for the models ---------------------------------------------


def fit_tfidf_vectors(
    corpus: DataFrame, text: str = "text", longest: int = 2, out: str = "features",
    min_share: float = K.MIN_DOC_SHARE, max_share: float = K.MAX_DOC_SHARE,
) -> PipelineModel:
    """Pipeline model from a ``tokens`` column to unit TF-IDF vectors.

    Fit on the training texts, or on a larger unlabelled corpus. The terms and
    their weights come from ``fit_vocabulary``; the model holds them, as any MLlib
    text model does, and their number is bounded by the minimum share.
    """
    fitted = fit_vocabulary(corpus, text, longest, min_share, max_share)
    rows = fitted.select("term", "idf").orderBy("term").collect()
    if not rows:
        raise ValueError("no term occurs in the wanted share of documents")
    counter = CountVectorizerModel.from_vocabulary(
        [r["term"] for r in rows], inputCol="tokens", outputCol="_tf"
    )
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="_tf", outputCol="_raw"
    )
    unit = Normalizer(p=2.0, inputCol="_raw", outputCol=out)
    return PipelineModel([counter, scale, unit])


def apply_tfidf_vectors(
    model: PipelineModel, df: DataFrame, text: str = "text", longest: int = 2
) -> DataFrame:
    """Add the vectors. ``longest`` may be smaller than at the fit. ``df`` is a table with texts, or a ``token_table``."""
    tokens = _grams(F.col("tokens") if "tokens" in df.columns else _tokens(text), longest, model.stages[0].vocabulary)
    return model.transform(df.withColumn("tokens", tokens)).drop("tokens", "_tf", "_raw")


def save_vectors(df: DataFrame, path: str, vector: str = "features") -> None:
    df.withColumn(vector, vector_to_array(vector, "float32")).write.parquet(path)
