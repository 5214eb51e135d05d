"""Exact n-gram Jaccard join in metric space, up to connected components.

Jaccard distance is a metric, but unrelated documents all lie at distance 1 from any
pivot, so pivots alone cannot divide a corpus. The first division is therefore by
content: documents within distance 1 - threshold share one of their first shingles
(a prefix of n - ceil(threshold * n) + 1 in one global order), so each shingle names a
region that replicates all documents that may have a partner in it. Inside regions the
metric works:

1. Equal sets are one class and travel as one node.
2. Each region's least node is its pivot. A node is measured against the pivot that it
   shares most regions with; nodes within the threshold fall into the pivot's cell. A
   cell is linked through its pivot, so its members are never compared with each other.
3. Regions whose nodes all got one label are done. The others join recursively: large
   ones take further pivots, four times as many in each round, and compare them with the nodes
   of other labels until what is left is small. A region is small when few of its nodes are
   outside its commonest label: these are compared with all nodes of other labels.
   Only what a region's place in the global order allows is compared: the pair's first
   common shingle stands there, so no more than the shingles behind it can be shared.
   Sizes (0.8 <= ratio), the triangle inequality over a pivot that both were measured
   against, and sketches, coordinates in which the sets' distance can only shrink, cut
   further pairs that cannot be near before sets are compared.
4. The join ends when no region with several labels is left, so no link between
   different sets can be missed.

The sets of nodes that have company in a region are written once. New links only change
the labels that they connect.

The global order puts shingles that are frequent within tasks last, by frequency, so
that shared passages name no region unless a document has little else; this affects
the work and never the result. Shingles and sets are known by 64-bit hashes.

Defined cases: null and empty texts have no shingles and are linked with nothing; texts
with fewer words than a shingle are one shingle; repeated keys and rows are nodes of
their class; a null key counts only where its component has no other; extra columns
stay out of the way (only key and text are read); an empty table gives no row.
"""
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpuslab.llm.bits import bit_table, in_table
from corpuslab.llm.columns import fresh
from corpuslab.llm.components import components
from corpuslab.llm.words import WordReader, text_batches, window_hashes
from corpuslab.storage import materialize

SHINGLE, NEAR = 5, (4, 5)
#: Shingles counted together, the count that makes one frequent there, and the most that are kept.
COUNTED, FREQUENT, MOST_FREQUENT = 2_000_000, 2, 1 << 18
#: Classes of shingles in sketches of sets below a size, and above all of them.
SKETCHES, MOST_CLASSES = ((1500, 128), (6000, 512)), 2048
#: Bytes of text that a task reads at a time, bytes of a batch that reaches it, and rows of counted shingles that leave it together.
GROUP_BYTES, BATCH_BYTES, COUNTED_ROWS = 1 << 18, 1 << 20, 1 << 15
#: Rows of texts or sets that a scan holds at a time.
SCAN_ROWS = 256
#: While labels are sought, shuffled tables are joined where they lie: each of the many joins would else build its broadcast
#: in the driver. Partitions of a moderate size are joined by hash and not sorted.
SETTINGS = {"spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}
#: Nodes of a region that share a task before it is dealt out further.
SALTED = 1000
#: Regions with up to so many nodes outside their commonest label are compared directly; others take pivots first, so many in the first round.
LEAF, PIVOTS = 48, 8


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The settings hold inside; afterwards what was set before holds again."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shingles(texts: list[str | None], reader: WordReader, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles."""
    words, bounds = reader.read(texts)
    windows, out = window_hashes(words, size), []
    for start, end in zip(bounds[:-1], bounds[1:]):
        if end - start >= size:
            found = np.sort(windows[start : end - size + 1])
            distinct = np.empty(len(found), bool)
            distinct[0] = True
            np.not_equal(found[1:], found[:-1], out=distinct[1:])
            out.append(found[distinct])
        else:
            out.append(window_hashes(words[start:end], end - start) if end > start else np.empty(0, np.uint64))
    return out


def identity(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def groups_of_texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about GROUP_BYTES of text, one row at least."""
    start, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for k, size in enumerate(sizes):
        if held and held + size > GROUP_BYTES:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def sketch(found: np.ndarray) -> bytes:
    """How many shingles fall into each class, up to 255; larger sets have more classes."""
    classes = next((c for n, c in SKETCHES if len(found) < n), MOST_CLASSES)
    return np.minimum(np.bincount((found & np.uint64(classes - 1)).astype(np.int64), minlength=classes), 255).astype(np.uint8).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """City-block distance of two sketches, the longer folded to the shorter one's classes."""
    left, right = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (a, b))
    classes = min(len(left), len(right))
    return int(np.abs(left.reshape(-1, classes).sum(axis=0) - right.reshape(-1, classes).sum(axis=0)).sum())


def counted(sets: list[np.ndarray], rows: int = COUNTED_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shingles, times) of those that are frequent in the sets, a bounded number at a time."""
    together = np.concatenate(sets)
    together.sort()
    starts = np.flatnonzero(np.concatenate([[True], together[1:] != together[:-1], [True]]))
    times = np.diff(starts)
    often = times >= FREQUENT
    shingle, times = together[starts[:-1][often]].view(np.int64), times[often]
    for at in range(0, len(shingle), rows):
        yield shingle[at : at + rows], times[at : at + rows]


def first_pass(docs: DataFrame, size: int) -> DataFrame:
    """Rows (key, node, n, sketch) of all documents, and rows (shingle, times) of those frequent in a task."""
    columns = ["key", "node", "n", "sketch", "shingle", "times"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, waiting, held = WordReader(), [], 0

        def frequent() -> Iterator[pa.RecordBatch]:
            for shingle, times in counted(waiting):
                none = [pa.nulls(len(shingle), t) for t in (kind, pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, pa.array(shingle), pa.array(times)], columns)
            waiting.clear()

        for whole in batches:
            for batch in groups_of_texts(whole):
                kind = batch.column("key").type
                sets = shingles(batch.column("text").to_pylist(), reader, size)
                waiting += sets
                held += sum(map(len, sets))
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column("key"), pa.array([identity(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([sketch(s) for s in sets], pa.binary()), none, none], columns)
                if held > COUNTED:
                    yield from frequent()
                    held = 0
        if held:
            yield from frequent()

    key = dict(docs.dtypes)["key"]
    return docs.mapInArrow(read, f"key {key}, node long, n long, sketch binary, shingle long, times long")


def postings(docs: DataFrame, size: int, frequent: np.ndarray, times: np.ndarray, near: tuple[int, int]) -> DataFrame:
    """(shingle, salt, salted, node, n, at) of the first shingles of each class, with their places; a class once per task."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, times))
    top, bottom = near
    columns = ["shingle", "salt", "salted", "node", "n", "at"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, times = shared.value
        reader, seen = WordReader(), set()
        for whole in batches:
            for batch in groups_of_texts(whole):
                parts, ranks, nodes, sizes = [], [], [], []
                for found in shingles(batch.column("text").to_pylist(), reader, size):
                    if not len(found) or (node := identity(found)) in seen:
                        continue
                    seen.add(node)
                    n = len(found)
                    length = n + (-top * n // bottom) + 1
                    rank = np.zeros(n, np.int64)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
                        rank = np.where(frequent[at] == found, times[at], 0)
                        if rank.any():
                            order = np.argsort(rank, kind="stable")[:length]
                            found, rank = found[order], rank[order]
                    parts.append(found[:length])
                    ranks.append(rank[:length])
                    nodes.append(node)
                    sizes.append(n)
                if parts:
                    lengths = list(map(len, parts))
                    rank, node = np.concatenate(ranks), np.repeat(np.array(nodes, np.int64), lengths)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(parts).view(np.int64)), pa.array((node % (rank // SALTED + 1)).astype(np.int32)), pa.array(rank > SALTED),
                        pa.array(node), pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                        pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths]))], columns)

    return docs.select("text").mapInArrow(read, "shingle long, salt int, salted boolean, node long, n int, at int")


def read_sets(docs: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """(node, members) of the documents whose key's hash is in the bit table."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = WordReader(), set()
        for whole in batches:
            chosen = whole.filter(pa.array(in_table(shared.value, whole.column("hash").to_numpy())))
            for batch in groups_of_texts(chosen):
                rows = {}
                for found in shingles(batch.column("text").to_pylist(), reader, size):
                    if len(found) and (node := identity(found)) not in seen:
                        seen.add(node)
                        rows[node] = found.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], ["node", "members"])

    return docs.select(F.xxhash64("key").alias("hash"), "text").mapInArrow(read, "node long, members binary")


def near_in_sketch(pairs: DataFrame, classes: DataFrame, near: tuple[int, int]) -> DataFrame:
    """The pairs (a, an, b, bn) whose sketches allow a link. Class counts are coordinates in
    which the city-block distance is at most the symmetric difference of the sets."""

    @F.arrow_udf("long")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([sketch_distance(x.as_buffer(), y.as_buffer()) for x, y in zip(a, b)], pa.int64())

    left, right = (classes.select(F.col("node").alias(c), F.col("sketch").alias("_" + c)) for c in "ab")
    met = pairs.join(left, "a").join(right, "b")
    # |A - B| + |B - A| <= (1 - t) / (1 + t) * (|A| + |B|) for sets of similarity t or more.
    return met.where(distance("_a", "_b") * (near[1] + near[0]) <= (F.col("an") + F.col("bn")) * (near[1] - near[0])).select(pairs.columns)


def measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add shared, the size of the intersection, to pairs (a, b)."""

    @F.arrow_udf("long")
    def intersection(a: pa.Array, b: pa.Array) -> pa.Array:
        sets = (np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)]) for x, y in zip(a, b))
        return pa.array([int((np.diff(np.sort(s)) == 0).sum()) for s in sets], pa.int64())

    # Sets that no pair asks for stay out of the shuffle.
    wanted = pairs.sparkSession.sparkContext.broadcast(bit_table(pairs.select(F.xxhash64("a").alias("hash")).union(pairs.select(F.xxhash64("b")))))

    @F.arrow_udf("boolean")
    def asked(hashes: pa.Array) -> pa.Array:
        return pa.array(in_table(wanted.value, hashes.to_numpy()))

    # Written, so that a task of the joins has one Python worker and not one more for each side.
    some = materialize(sets.where(asked(F.xxhash64("node"))), "jaccard-asked")
    wanted.destroy()
    left = some.select(F.col("node").alias("a"), F.col("members").alias("_a"))
    right = some.select(F.col("node").alias("b"), F.col("members").alias("_b"))
    return pairs.join(left, "a").join(right, "b").withColumn("shared", intersection("_a", "_b")).drop("_a", "_b")


def most_frequent(counted: DataFrame, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, ascending, and their times: those from the least power of two on that keeps the list within `most`."""
    counted = materialize(counted, "jaccard-frequent")
    level = F.floor(F.log2("times")).cast("int")
    total, least = 0, 64
    # One row per power of two.
    for power, n in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = power
    table = counted.where(level >= least).toArrow()
    shingle, times = table.column("shingle").to_numpy().view(np.uint64), table.column("times").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], times[order]


def may_be_near(n, m, near: tuple[int, int]):
    return (F.least(n, m) * near[1] >= F.greatest(n, m) * near[0])


def is_near(shared, n, m, near: tuple[int, int]):
    return shared * near[1] >= (n + m - shared) * near[0]


def can_meet(n, at, m, other, near: tuple[int, int]):
    """Can two sets whose first common shingle stands at these places be near? They share no more than what follows."""
    top, bottom = near
    return F.least(n - at, m - other) * (top + bottom) >= (n + m) * top


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: only those that the links connect are merged."""
    ends = links
    for c in "ab":
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("label").alias("_" + c)), c, "left").withColumn("_" + c, F.coalesce("_" + c, c))
    merged = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    changed = merged.select(F.col("node").alias("label"), F.col("label").alias("_new"))
    old = labels.join(changed, "label", "left").select("node", F.coalesce("_new", "label").alias("label"))
    return materialize(old.union(merged.join(labels, "node", "left_anti").select("node", "label")), "jaccard-labels")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, near: tuple[int, int] = NEAR,
         leaf: int = LEAF, pivots: int = PIVOTS) -> DataFrame:
    """Per document: key, n_shingles, and component_id, the least key that links reach."""
    with held(docs.sparkSession, SETTINGS):
        documents, labels = labelled(docs, key, text, size, near, leaf, pivots)
    return assign(documents, labels).withColumnsRenamed({"key": key, "n": "n_shingles"})


def labelled(docs: DataFrame, key: str, text: str, size: int, near: tuple[int, int], leaf: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, node, n) of all documents, and the (node, label) of nodes with links."""
    text_batches(docs.sparkSession, BATCH_BYTES)
    # A scan's buffers grow with its rows times their bytes: at Spark's 4,096, tens of MB for each task.
    docs.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    read = materialize(first_pass(docs, size), "jaccard-documents")
    documents = read.where("node is not null").select("key", "node", "n")
    classes = materialize(
        read.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.first("sketch").alias("sketch")), "jaccard-classes")
    frequent, times = most_frequent(read.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")))

    # Members of regions of two nodes or more, each with its region's pivot. A salted region
    # has a pivot in each part, and these have one of their own.
    part, whole = Window.partitionBy("shingle", "salt"), Window.partitionBy("shingle")
    one = F.struct("node", "n", "at")
    rows = postings(docs, size, frequent, times, near).withColumn("pivot", F.min(one).over(part))
    other = F.col("pivot.node") != F.col("node")
    rows = materialize(rows.where(other | F.col("salted")).select("shingle", "node", "n", "at", "pivot"), "jaccard-regions")
    # Written, as three tables are made of it.
    heads = materialize(rows.where(~other).withColumn("pivot", F.min(one).over(whole)).where(other), "jaccard-heads")
    members = rows.where(other).union(heads)
    # Each node against the pivot that it shares most regions with, of those it may be near.
    n, at, pn, pat = (F.col(c) for c in ("n", "at", "pivot.n", "pivot.at"))
    met = members.where(may_be_near(n, pn, near) & can_meet(n, at, pn, pat, near)).groupBy(
        F.col("node").alias("a"), n.alias("an"), F.col("pivot.node").alias("b"), pn.alias("bn")).agg(F.count("*").alias("times"))
    best = near_in_sketch(met, classes, near).groupBy("a", "an").agg(F.max_by(F.struct("b", "bn"), F.struct("times", "b")).alias("best"))
    pairs = materialize(best.select("a", "an", F.col("best.b").alias("b"), F.col("best.bn").alias("bn")), "jaccard-candidates")

    # In a pair that can be near, the smaller set has the shingle among its first ninth or so (at the
    # threshold 4 / 5): a region without such a member joins nothing.
    first = (n - at) * (near[0] + near[1]) >= 2 * n * near[0]
    every = members.select("shingle", "node", "n", "at").union(members.select("shingle", "pivot.node", "pivot.n", "pivot.at").distinct())
    useful = every.groupBy("shingle").agg(F.max(first).alias("any"), F.count("*").alias("size")).where("any and size > 1").select("shingle")
    open_ = materialize(every.join(useful, "shingle", "left_semi").distinct(), "jaccard-open")
    nodes = open_.select("node").union(pairs.select("a")).union(pairs.select("b"))
    keys = classes.join(nodes, "node", "left_semi").select(F.xxhash64("key").alias("hash"))
    sets = materialize(read_sets(docs, size, bit_table(keys)), "jaccard-sets")

    measured = materialize(measure(pairs, sets), "jaccard-cells")
    labels = components(measured.where(is_near(F.col("shared"), F.col("an"), F.col("bn"), near)).select("a", "b"))
    place = measured.select(F.col("a").alias("node"), F.col("b").alias("_p"), (1 - F.col("shared") / (F.col("an") + F.col("bn") - F.col("shared"))).alias("_d"))
    open_, tried = open_.join(place, "node", "left"), measured.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # Regions in which labels differ join recursively.
    turn = 0
    while True:
        tagged = open_.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        # Nodes that have their region's commonest label are not compared with each other: its work goes with the rest.
        by_label = tagged.groupBy("shingle", "label").agg(F.count("*").alias("n"), F.max(first).alias("any"))
        facts = by_label.groupBy("shingle").agg(
            F.max_by("label", F.struct("n", "label")).alias("_main"), (F.sum("n") - F.max("n")).alias("_rest"), F.max("any").alias("_any"))
        tagged = materialize(tagged.join(facts.where("_rest > 0 and _any").drop("_any"), "shingle"), "jaccard-open")
        large = tagged.groupBy().agg(F.max("_rest")).first()[0]
        if large is None:
            break
        direct, divided = tagged.where(F.col("_rest") <= leaf), tagged.where(F.col("_rest") > leaf)
        held = ["node", "n", "at", "label", "_p", "_d"]
        order = Window.partitionBy("shingle").orderBy(F.xxhash64("node", F.lit(turn)), "node")
        chosen = divided.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= pivots << 2 * turn)
        y = F.struct(*held).alias("y")
        apart = (F.col("label") != F.col("y.label")) & may_be_near(n, F.col("y.n"), near) & can_meet(n, at, F.col("y.n"), F.col("y.at"), near)
        # |d(x, p) - d(y, p)| is at most d(x, y); a little is allowed for rounding.
        reach = 1 - near[0] / near[1] + 1e-9
        apart &= ~F.coalesce((F.col("_p") == F.col("y._p")) & (F.abs(F.col("_d") - F.col("y._d")) > reach), F.lit(False))
        once = (F.col("y.label") == F.col("_main")) | (F.col("node") < F.col("y.node"))
        met = direct.where("label != _main").join(direct.select("shingle", y), "shingle").where(apart & once)
        if large > leaf:
            chosen = materialize(chosen.select("shingle", y), "jaccard-pivots")
            met = met.union(divided.join(chosen, "shingle").where(apart))
        smaller = F.col("node") < F.col("y.node")
        pairs = met.select(
            F.least("node", "y.node").alias("a"), F.when(smaller, n).otherwise(F.col("y.n")).alias("an"),
            F.greatest("node", "y.node").alias("b"), F.when(smaller, F.col("y.n")).otherwise(n).alias("bn"),
        ).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = materialize(near_in_sketch(pairs, classes, near), "jaccard-candidates")
        measured = materialize(measure(pairs, sets), "jaccard-pairs")
        new = measured.where(is_near(F.col("shared"), F.col("an"), F.col("bn"), near)).select("a", "b")
        if not new.isEmpty():
            labels = relabel(labels, new)
        if large <= leaf:
            break
        tried = tried.union(measured.select("a", "b"))
        open_ = divided.join(chosen.select("shingle", F.col("y.node").alias("node")), ["shingle", "node"], "left_anti").select("shingle", "node", "n", "at", "_p", "_d")
        turn += 1

    return documents, labels


def assign(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, n, component_id): the least key of each component, through one row per class."""
    node = F.when(F.col("n") > 0, F.col("node"))
    documents = documents.select("key", "n", node.alias("node"))
    keys = documents.where("node is not null").groupBy("node").agg(F.min("key").alias("first"))
    labelled = keys.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_class = labelled.join(least, "label").select("node", "component_id")
    return documents.join(by_class, "node", "left").select("key", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component, with the columns of `docs`. Rows are told apart by key and
    text, so a repeated or null key loses no other text; of wholly equal rows one stays."""
    row, place = fresh(docs, "_row"), fresh(docs, "_place")
    docs = docs.withColumn(row, F.xxhash64(key, text))
    joined = join(docs.select(row, text), row, text, **options)
    first = joined.where(F.col(row) == F.col("component_id")).select(row).distinct()
    number = F.row_number().over(Window.partitionBy(row).orderBy(row))
    return docs.join(first, row, "left_semi").withColumn(place, number).where(F.col(place) == 1).drop(row, place)
