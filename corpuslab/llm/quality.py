"""Quality rules with thresholds that adapt to each language and source.

Per document a task measures words, symbols, capitals, repeated lines and repeated
five-word windows. Quantiles of the shares come from mergeable sketches: counts of
values in buckets that grow by 2 %, so a quantile is right within 1 % of its value,
merging is a sum, and one huge source costs no more than the map tasks' partial sums.
A fence lies `width` spreads (75 % - 25 % quantile, at least the rule's floor) beyond
the quartile; a document beyond any fence is rejected. A group with fewer than
`least_group` documents takes the merged sketch of its language, a small language that
of all documents.

Defined cases: a null text counts as empty and fails the base rule; null languages and
sources are groups of their own; repeated rows are judged alike; extra columns stay
(those named like the operator's are replaced); an empty table gives an empty one.
"""
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.columns import free, packed
from corpuslab.llm.words import text_batches
from corpuslab.storage import materialize

#: The characters that count as symbols, and the bytes that end words.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"

WINDOW = 5
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"
)


class Rule(NamedTuple):
    """A share, its least spread, and which fences hold."""

    share: str
    floor: float
    below: bool = False


#: Production rules: share -> numerator / denominator, see `shares`.
RULES = (
    Rule("symbol_share", 0.02),
    Rule("capital_share", 0.09),
    Rule("dup_line_share", 0.08),
    Rule("word_length", 0.5, below=True),
)
#: Columns that the operator adds, for good or on the way.
OWN = [m.split()[0] for m in MEASURES.split(", ")] + ["base_failed", "kept", "lower", "upper", "_m", "_l", "_s"]

FENCE_WIDTH, LEAST_GROUP, GROWTH = 4.0, 50, 1.02


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, covered = Counter(windows), 0
        for start, window in enumerate(windows):
            if seen[window] > 1:
                repeated += start + WINDOW - max(covered, start)
                covered = start + WINDOW
    spaces = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    # Letters that lower-casing changes are capitals; ASCII texts take the faster way.
    if text.isascii():
        capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    else:
        capitals = sum(n for c, n in Counter(text).items() if c.isupper())
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines), capitals


def with_measures(docs: DataFrame) -> DataFrame:
    """Add MEASURES and base_failed."""
    names = [m.split()[0] for m in MEASURES.split(", ")]
    text_batches(docs.sparkSession)
    docs = free(docs, *OWN)

    @F.pandas_udf(MEASURES)
    def measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([measure(t) for t in batch], columns=names, dtype="int64")

    docs = docs.withColumn("_m", measures("text"))
    docs = docs.withColumns({n: F.col(f"_m.{n}") for n in names}).drop("_m")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return docs.withColumn("base_failed", failed)


def shares() -> dict[str, Column]:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_share": ratio("n_symbols", "word_chars"),
        "capital_share": ratio("n_capitals", "word_chars"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "word_length": ratio("word_chars", "n_words"),
    }


def bucket(value: Column) -> Column:
    """Bucket of a value >= 0; values under 1e-6 share one."""
    return F.floor(F.log(F.greatest(value, F.lit(1e-6))) / F.log(F.lit(GROWTH))).cast("int")


def bucket_value(b: Column) -> Column:
    middle = F.pow(F.lit(GROWTH), b + 0.5)
    return F.when(middle <= 1.1e-6, 0.0).otherwise(middle)


def sketch(measured: DataFrame) -> DataFrame:
    """Counts per lang, source, rule number and bucket of the documents that pass the base rule."""
    values = F.array(*(bucket(shares()[r.share]) for r in RULES))
    return (
        measured.where(~F.col("base_failed"))
        .select("lang", "source", F.posexplode(values).alias("rule", "bucket"))
        .groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))
    )


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Per group a map of rule number -> (25 % quantile, 75 % quantile), and the group's documents."""
    merged = sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    at = lambda q: bucket_value(F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bucket"))))
    per_rule = ranked.groupBy(*keys, "rule").agg(at(0.25).alias("low"), at(0.75).alias("high"), F.max("total").alias("total"))
    return per_rule.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", F.struct("low", "high")))).alias("found"), F.max("total").alias("total")
    )


def fences(sketches: DataFrame, width: float = FENCE_WIDTH, least_group: int = LEAST_GROUP) -> DataFrame:
    """Per lang and source the fences of all rules: arrays lower and upper by rule number.

    The tables here hold one row per group, rule and bucket: their size follows the
    number of languages and sources, not that of documents.
    """
    of_source = quartiles(sketches, ["lang", "source"])
    of_lang = quartiles(sketches, ["lang"]).select(F.col("lang").alias("_l"), F.col("found").alias("_lf"), F.col("total").alias("_lt"))
    # One row: the quartiles of each rule over all documents.
    of_all = quartiles(sketches.withColumn("_one", F.lit(1)), ["_one"]).first()
    of_all = F.create_map(*(
        x for rule, (low, high) in sorted(of_all["found"].items())
        for x in (F.lit(rule), F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))))) if of_all else F.lit(None)
    chosen = of_source.join(of_lang, F.col("lang").eqNullSafe(F.col("_l")), "left").withColumn(
        "use", F.when(F.col("total") >= least_group, F.col("found")).when(F.col("_lt") >= least_group, F.col("_lf")).otherwise(of_all))
    lower, upper = [], []
    for k, rule in enumerate(RULES):
        low, high = F.col("use")[k]["low"], F.col("use")[k]["high"]
        spread = F.greatest(high - low, F.lit(rule.floor))
        lower.append(low - width * spread if rule.below else F.lit(float("-inf")))
        upper.append(high + width * spread)
    return chosen.select("lang", "source", F.array(*lower).alias("lower"), F.array(*upper).alias("upper"))


def judge(docs: DataFrame, width: float = FENCE_WIDTH, least_group: int = LEAST_GROUP, carry_text: bool = True) -> DataFrame:
    """Add MEASURES, base_failed and kept to `docs` (text, lang, source).

    Texts are measured once, in the task that reads them, and the measured rows are
    written; sketches and verdicts come from that table. Without `carry_text` it leaves
    the text out.
    """
    measured = with_measures(docs)
    measured = materialize(measured if carry_text else measured.drop("text"), "quality")
    limits = fences(sketch(measured), width, least_group).withColumnsRenamed({"lang": "_l", "source": "_s"})
    joined = measured.join(
        limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    inside = F.lit(True)
    for k, rule in enumerate(RULES):
        share = shares()[rule.share]
        inside = inside & (share <= F.col("upper")[k]) & (share >= F.col("lower")[k])
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.withColumn("kept", kept).drop("_l", "_s", "lower", "upper")


def keep(docs: DataFrame, **options) -> DataFrame:
    """The documents that `judge` keeps, with their own columns."""
    shaped, columns = packed(docs, OWN, ["text", "lang", "source"])
    return judge(shaped, **options).where("kept").select(columns)
