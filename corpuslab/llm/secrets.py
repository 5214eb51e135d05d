"""Secrets by patterns and by a battery of randomness tests, in DataFrame functions only.

Patterns give spans of three kinds (assign, access, hex). Beyond them, every run of
LEAST_RUN or more token characters that touches no such span is a candidate. Its
encoding is inferred from its characters, and three tests ask whether it looks as
random as that encoding allows, against ordinary text:

* chi-squared uniformity over the encoding's alphabet: ordinary text repeats its
  letters, so its statistic is noncentral; p is the lower tail at what was seen;
* runs of digits, capitals and small letters: text seldom changes class; p is the
  Chernoff bound on as many changes or more;
* serial correlation of neighbouring symbols: random symbols have none, so a candidate
  with a clear one is set aside (p = 1).

The p values are combined (twice the smaller), and a false-discovery rate of `rate` is
held within each band of lengths, since short runs make up most candidates and prove
least: counts of p values in steps of a tenth of a power of ten are summed over the
whole table, and the largest step that Benjamini and Hochberg's bound allows is the
band's threshold. Accepted candidates become spans of kind random.

Defined cases: a null text is empty and has no spans; positions count code points, the
end is exclusive; repeated rows are judged alike; extra columns stay (those named
like the operator's are replaced); an empty table gives an empty one.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.columns import free
from corpuslab.storage import materialize

#: The patterns, with the least lengths of what they find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

LEAST_RUN = 20
#: Runs of token characters; nothing is tried again inside a run.
RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_RUN},}}+={{0,2}}"
#: Lower bounds of the bands of lengths.
BANDS = (LEAST_RUN, 32, 64)
RATE = 0.01

#: Chance that two letters of ordinary text are equal; digits and hex letters repeat more.
TEXT_REPEATS, HEX_REPEATS = 0.065, 0.2
#: Chance that neighbours in ordinary text differ in class, and the clear serial correlation.
TEXT_CHANGES, SERIAL_LIMIT = 0.1, 3.0

#: Encodings in the order of inference: pattern and alphabet.
LETTERS, CAPITALS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+=*$", CAPITALS + "234567"),
    ("^[a-z]+$", LETTERS),
    ("^[a-z0-9]+$", LETTERS + DIGITS),
    ("^[A-Za-z0-9]+$", CAPITALS + LETTERS + DIGITS),
    ("", CAPITALS + LETTERS + DIGITS + "+/-_"),
)


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def located(text: Column, pattern: str, kind: str) -> Column:
    """Structs (start, no, kind, end, value) of all matches; empty without one."""

    def spans(found: Column) -> Column:
        # The text between the matches, and the matches, in turn: starts are running sums of lengths.
        between = F.transform(F.split(text, pattern, -1), F.length)
        sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("value")))
        none = F.slice(F.array(span(F.lit(0), F.lit(""))), 1, 0)
        start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        summed = F.aggregate(sizes, start, lambda a, m: F.struct(
            (a["at"] + m["gap"] + F.length(m["value"])).alias("at"),
            F.concat(a["spans"], F.array(span(a["at"] + m["gap"], m["value"]))).alias("spans")))
        # The text is cut again only where something was found.
        return F.when(F.size(found) > 0, summed["spans"]).otherwise(none)

    def span(start: Column, value: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("no"), F.lit(kind).alias("kind"),
                        (start + F.length(value)).alias("end"), value.alias("value"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def base_spans(text: Column) -> Column:
    long_value = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST_VALUE
    return F.array_sort(F.concat(
        F.filter(located(text, ASSIGN, "assign"), long_value), located(text, ACCESS, "access"), located(text, HEX, "hex")))


def log_normal_tail(z: Column) -> Column:
    """Natural logarithm of the upper tail of the normal distribution, good to a few percent."""
    return -F.log1p(F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(600.0))))


def steps_of_p(value: Column) -> Column:
    """-10 log10 of the battery's p value, as an integer from 0 to 400."""
    return let(F.regexp_replace(value, "=+$", ""), _steps)


def _steps(value: Column) -> Column:
    size = F.length(value).cast("double")
    total = lambda array, of: F.aggregate(array, F.lit(0.0), lambda a, v: a + of(v))

    def uniformity(alphabet: str, repeats: float) -> Column:
        k = len(alphabet)
        times = F.transform(F.split(F.lit(alphabet), ""), lambda c: size - F.length(F.replace(value, c, F.lit(""))))
        seen, excess = k / size * total(times, lambda n: n * n) - size, size * (k * repeats - 1)
        return log_normal_tail((k - 1 + excess - seen) / F.sqrt(2 * (k - 1) + 4 * excess))

    def serial(alphabet: str) -> Column:
        """Correlation of neighbours times the root of the length, from plain sums."""

        def correlation(x: Column) -> Column:
            steps = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: a * b)
            mean = total(x, lambda v: v) / size
            ends = F.element_at(x, 1) + F.element_at(x, -1)
            together = let(mean, lambda m: total(steps, lambda v: v) - m * (2 * size * m - ends) + (size - 1) * m * m)
            spread = total(x, lambda v: v * v) - size * mean * mean
            return together / F.greatest(spread, F.lit(1e-9)) * F.sqrt(size)

        return let(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double")), correlation)

    uniform, related = F.lit(None), F.lit(None)
    for pattern, alphabet in reversed(ENCODINGS):
        here = value.rlike(pattern) if pattern else F.lit(True)
        repeats = HEX_REPEATS if len(alphabet) == 16 else TEXT_REPEATS
        uniform = F.when(here, uniformity(alphabet, repeats)).otherwise(uniform)
        related = F.when(here, serial(alphabet)).otherwise(related)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")

    def runs(changed: Column) -> Column:
        bound = changed * F.log(F.greatest(changed, F.lit(1e-9)) / TEXT_CHANGES) + (1 - changed) * F.log((1 - changed) / (1 - TEXT_CHANGES))
        return F.when(changed > TEXT_CHANGES, -(size - 1) * bound).otherwise(0.0)

    by_runs = let(F.least((F.length(classes) - 1) / F.greatest(size - 1, F.lit(1.0)), F.lit(1 - 1e-9)), runs)
    log_p = F.when(F.abs(related) > SERIAL_LIMIT, 0.0).otherwise(F.least(F.least(uniform, by_runs) + F.log(F.lit(2.0)), F.lit(0.0)))
    return F.least(F.floor(-10 * log_p / F.log(F.lit(10.0))), F.lit(400)).cast("int")


def band(size: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(BANDS[1:], 1):
        out = F.when(size >= least, k).otherwise(out)
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by base (spans) and tried (candidates with band and steps)."""
    docs = free(docs, "base", "tried", "spans", "_text", "_runs").withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    docs = docs.withColumn("base", base_spans(F.col("_text"))).withColumn("_runs", located(F.col("_text"), RUN, "random"))
    apart = F.filter("_runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    tested = F.transform(apart, lambda r: F.struct(
        r["start"].alias("start"), r["no"].alias("no"), r["kind"].alias("kind"), r["end"].alias("end"),
        band(r["end"] - r["start"]).alias("band"), steps_of_p(r["value"]).alias("steps")))
    return docs.withColumn("tried", tested).withColumn("base", F.transform("base", lambda b: b.dropFields("value"))).drop(text, "_text", "_runs")


def thresholds(scanned: DataFrame, rate: float = RATE) -> list[int | None]:
    """The least steps that are accepted in each band; None where nothing is."""
    counts = scanned.select(F.explode("tried").alias("t")).groupBy("t.band", "t.steps").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("band")
    counts = counts.withColumns({"m": F.sum("n").over(whole), "beyond": F.sum("n").over(whole.orderBy(F.desc("steps")))})
    allowed = F.pow(F.lit(10.0), -F.col("steps") / 10) <= rate * F.col("beyond") / F.col("m")
    # At most one row per band comes to the driver.
    rows = dict(counts.where(allowed).groupBy("band").agg(F.min("steps")).collect())
    return [rows.get(k) for k in range(len(BANDS))]


def find(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """`docs` with spans (array of start, no, kind, end, sorted by start, then kind) and base
    (those of the patterns alone) in place of the text. Texts are read once; what was found
    is written before the thresholds are set over all of it."""
    scanned = materialize(scan(docs, text), "secrets")
    least = thresholds(scanned, rate)
    accepted = lambda t: F.coalesce(
        *(F.when(t["band"] == k, t["steps"] >= n) for k, n in enumerate(least) if n is not None), F.lit(False))
    added = F.transform(F.filter("tried", accepted), lambda t: t.dropFields("band", "steps"))
    return scanned.withColumn("spans", F.array_sort(F.concat("base", added))).drop("tried")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
