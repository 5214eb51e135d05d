"""Mixing sources to target weights along a curriculum.

Each source gets a target from its weight: the shares of the total size, capped at
`epochs` times the source's size, with the excess shared again by weight (water
filling in one pass over the sources ordered by cap / weight). Each source also has a
weight schedule over training time 0..1, linear between knots. The integral of the
schedule is the source's cumulative token demand; a document that begins after c of
its source's taken tokens is needed when demand reaches c, so its training position
is the inverse of the integral at c / target. Positions of all sources compare: a
range sort by position yields the training order with the scheduled mixture.

Documents of a source follow each other in a seeded hash order. The running size is
summed in two steps, within hash buckets and over the buckets' totals, so a source with
a third of all rows is spread over `buckets` groups. A source that wants more than its
size is passed again, up to `epochs` times; the last document of the mix is cut.

Defined cases: a null text has size 0 and is not taken; a null source is a source of
its own, last; a source or corpus of size 0 has target 0; repeated rows are mixed one
by one; extra columns stay (those named like the operator's are replaced); an empty table gives an empty one. Windows without a
partition run over one row per source.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.columns import free
from corpuslab.llm.words import SPACE_CLASS

#: Production schedule by weight class: (time, weight) knots. Light sources fade, heavy ones grow.
FADING, EVEN, GROWING = [(0.0, 1.5), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (1.0, 1.5)]

EPOCHS, BUCKETS, SEED = 3, 1024, 20

#: Columns that the operator adds, for good or on the way.
OWN = "source_size target taken copies position weight pieces rank cap level _place _bucket _within _s _b _before _n _start _total _c".split()


def cycled_weight(rank: Column) -> Column:
    """1, 2, 3, repeating by the rank of the source (from 0)."""
    return (rank % 3 + 1).cast("double")


def knots(pairs: list[tuple[float, float]]) -> Column:
    return F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in pairs))


def cycled_schedule(rank: Column) -> Column:
    return F.when(rank % 3 == 0, knots(FADING)).when(rank % 3 == 1, knots(EVEN)).otherwise(knots(GROWING))


def segments(schedule: Column) -> Column:
    """Pieces (t0, w0, t1, w1, c0, c1) of a schedule, scaled to a whole integral of 1."""
    at = lambda i: F.element_at(schedule, i.cast("int"))
    steps = F.sequence(F.lit(1), F.size(schedule) - 1)
    area = lambda i: (at(i)["w"] + at(i + 1)["w"]) / 2 * (at(i + 1)["t"] - at(i)["t"])
    areas = F.transform(steps, area)
    upto = lambda n: F.aggregate(F.slice(areas, F.lit(1), n), F.lit(0.0), lambda a, x: a + x)
    whole = upto(F.size(areas))
    return F.transform(steps, lambda i: F.struct(
        at(i)["t"].alias("t0"), (at(i)["w"] / whole).alias("w0"), at(i + 1)["t"].alias("t1"), (at(i + 1)["w"] / whole).alias("w1"),
        (upto(i - 1) / whole).alias("c0"), (upto(i) / whole).alias("c1"),
    ))


def invert(pieces: Column, share: Column) -> Column:
    """The time at which the integral of a schedule reaches `share` (0..1)."""
    reaching = F.filter(pieces, lambda p: p["c1"] >= share)
    p = F.coalesce(F.get(reaching, F.lit(0)), F.element_at(pieces, -1))
    rest = F.greatest(share - p["c0"], F.lit(0.0))
    slope = (p["w1"] - p["w0"]) / (p["t1"] - p["t0"])
    below = p["w0"] + F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * slope * rest, F.lit(0.0)))
    return F.when(below > 0, F.least(p["t0"] + 2 * rest / below, p["t1"])).otherwise(p["t0"])


def plan_sources(docs: DataFrame, weight=cycled_weight, schedule=cycled_schedule, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source_size, weight, target, and the pieces of its schedule."""
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    sources = sources.withColumns({"weight": weight(F.col("rank")), "cap": (epochs * F.col("source_size")).cast("double")})
    # Caps fill in the order of cap / weight: those before have reached theirs if this one has.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    sources = sources.withColumn("level", level)
    full = F.col("cap") <= F.col("level") * F.col("weight")
    # Levels fall again behind the first source that is not full: the highest is the common one.
    shared = F.max(F.when(~full, F.col("level"))).over(Window.partitionBy())
    target = F.when(full, F.col("cap")).otherwise(F.least(F.col("cap"), shared * F.col("weight")))
    return sources.select("source", "source_size", "weight", target.alias("target"), segments(schedule(F.col("rank"))).alias("pieces"))


def mix(docs: DataFrame, key: str = "doc_id", weight=cycled_weight, schedule=cycled_schedule, epochs: int = EPOCHS,
        buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Add source_size, target, taken and copies (array of copy, words, position) to `docs`,
    which has a key, a source and a long `size`. `weight` and `schedule` map the rank of a
    source by name to its weight and to its knots."""
    docs = free(docs, *OWN).withColumn("_place", F.xxhash64(F.lit(seed), F.col(key)))
    docs = docs.withColumn("_bucket", F.pmod(F.shiftright("_place", 20), F.lit(buckets)))
    sources = plan_sources(docs, weight, schedule, epochs)
    totals = docs.groupBy("source", "_bucket").agg(F.sum("size").alias("_total"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "_bucket").orderBy("_place", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        docs.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(totals, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .join(sources.withColumnRenamed("source", "_n"), F.col("source").eqNullSafe(F.col("_n")))
        .withColumn("_start", F.col("_before") + F.col("_within"))
    )
    wanted = F.round("target").cast("long")

    def copy(k: Column) -> Column:
        start = k * F.col("source_size") + F.col("_start")
        words = F.least(F.greatest(wanted - start, F.lit(0)), F.col("size"))
        share = start / F.greatest(F.col("target"), F.lit(1.0))
        return F.struct(k.cast("int").alias("copy"), words.alias("words"), invert(F.col("pieces"), share).alias("position"))

    copies = F.filter(F.transform(F.array(*(F.lit(k) for k in range(epochs))), copy), lambda c: c["words"] > 0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return placed.withColumn("copies", copies).withColumn("taken", taken).drop(
        "_place", "_bucket", "_within", "_s", "_b", "_before", "_n", "_start", "weight", "pieces")


def training_order(mixed: DataFrame, text: str = "text") -> DataFrame:
    """One row per copy, sorted by position over all partitions; a cut copy has the first
    words of its text, joined by single spaces."""
    words = F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    rows = mixed.withColumn("_c", F.explode("copies")).withColumn("position", F.col("_c.position"))
    cut = F.col("_c.words") < F.col("size")
    first = F.array_join(F.slice(words, F.lit(1), F.col("_c.words").cast("int")), " ")
    return rows.withColumn(text, F.when(cut, first).otherwise(F.col(text))).orderBy("position").drop("_c", "copies")
