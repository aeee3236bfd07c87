"""Operator 2: near-duplicates of word shingles by bottom-k sketches of one hash function.

A text's set holds its distinct runs of ``width`` words (A-Z lower-cased, words parted by ASCII
white space; a shorter text is one run).  The k smallest hashes of a set are its sketch.  Inverted
lists of sketch values generate candidates, an estimate on the sketch of the union filters them,
and the Jaccard similarity of the full sets confirms every link.

What is listed of a sketch is its prefix in order of rarity.  A pair with similarity >= 0.8 shares
at least ``need`` of k sketch values (28 of 64 but for a chance below 1e-10; all-but-exact for
smaller sets, whose sketch is the set), so any two similar sets meet in a list of prefixes that
leave out need - 1 values.  The order comes from a histogram of fixed size over hash buckets.

A list's rows carry 128 bits more, one from the smallest hash in each of 128 bins; similar sets
differ in an eighth of them at most on average, and in more than ``FAR`` with a chance below 1e-10,
so the join of a list with itself drops most pairs of strangers before it returns them.

Equal sets are one class from the start.  In a list, only pairs of different components are ever
compared: a first round compares all with one member, and so do others while many pairs are left;
the last one compares all that are still apart, by exact overlaps, in blocks of full sets.  So a
group of a thousand copies costs about a thousand comparisons, and no link between components is
lost.

Null and empty texts, or texts without words, have an empty set and link with nothing.  Rows with a
null id are returned, without links and with a null component.  Rows that repeat an id share its
component.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.common import cut, partitions
from quire.llm.components import components

#: Values in a sketch, and how many of them similar sets share at least.
K, NEED = 64, 28
#: Buckets of the rarity histogram and bits of the filter of wanted ids: both of fixed size.
BUCKETS, BITS = 1 << 18, 1 << 23
#: Bits in which the 128-bit marks of similar sets may differ.
FAR = 40
#: Words whose hash a worker remembers.
REMEMBERED = 200_000
#: Sets and values in a block of a bundle, and elements whose overlaps are counted at a time.
BLOCK, BLOCK_VALUES, STRIPE = 256, 1 << 19, 4096
#: Rounds that compare with one member of each list before all remaining pairs are compared.
STAR_ROUNDS = 2
#: Pairs still apart, by rows of the lists, that the last round takes on.
AT_ONCE = 50


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 63-bit hashes of a text's shingles."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.int64)
        known = self.known
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > REMEMBERED:
            known.clear()
        width = min(self.width, len(words))
        run = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            run = _mix(run * np.uint64(3) + hashes[k : len(words) - width + 1 + k])
        return np.unique((run >> np.uint64(1)).astype(np.int64))


def mark(hashes: np.ndarray) -> tuple[int, int]:
    """One bit of the smallest hash in each of 128 bins; 0 for an empty bin."""
    bins = hashes & 127
    found, first = np.unique(bins, return_index=True)  # the hashes are sorted, so the first is the smallest
    bits = np.zeros(128, np.uint8)
    bits[found] = (hashes[first] >> 7) & 1
    one, two = np.frombuffer(np.packbits(bits).tobytes(), np.int64).tolist()
    return one, two


def sketches(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """Rows (key, body, n, digest, sketch, x, y): hash of the text; size, digest, k smallest hashes and mark of each set."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            sets = [shingle(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s[:K] for s in sets], pa.list_(pa.int64())),
                    *(pa.array([m[k] for m in map(mark, sets)], pa.int64()) for k in (0, 1)),
                ],
                ["key", "body", "n", "digest", "sketch", "x", "y"],
            )

    schema = T.StructType(
        [T.StructField("key", docs.schema[key].dataType), T.StructField("body", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))]
        + [T.StructField(c, T.LongType()) for c in "xy"]
    )
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("body")).mapInArrow(run, schema)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(NEED, -(-percent * n // 100))


def _filter(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each value of ``column``, in words of 32: at most bits / 32 rows come to the driver."""
    cells = hashes.select(F.shiftright(column, 5).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast({column} & 31 as int))").alias("mask"))
    found = cells.groupBy("cell").agg(F.bit_or("mask").alias("mask")).toPandas()
    filled = np.zeros(bits // 32, np.uint32)
    filled[found["cell"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).astype(np.uint32)
    return filled


def _inside(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filled[at >> 5] >> (at & 31).astype(np.uint32)) & 1 > 0


def postings(classes: DataFrame, percent: int) -> DataFrame:
    """Rows (value, rep, n, x, y) of lists with others: the prefix of each sketch in order of rarity."""
    spark = classes.sparkSession
    bucket = F.pmod(F.col("value"), F.lit(BUCKETS))
    counted = classes.select(F.explode("sketch").alias("value")).groupBy(bucket.cast("int").alias("bucket")).count().toPandas()  # at most BUCKETS rows
    histogram = np.zeros(BUCKETS, np.int64)
    histogram[counted["bucket"].to_numpy(np.int64)] = counted["count"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(histogram)
    kind = classes.schema["rep"]

    def prefixes(wanted):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rarity = shared.value
            for batch in batches:
                lists = batch.column(2)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((flat, rarity[flat % BUCKETS], owner))
                place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                n = batch.column(1).to_numpy(zero_copy_only=False)
                picked = order[place < np.repeat(sizes - needed(n, percent) + 1, sizes)]
                if wanted is None:
                    yield pa.RecordBatch.from_arrays([pa.array(flat[picked])], ["value"])
                    continue
                picked = picked[_inside(wanted.value, flat[picked] & (BITS - 1))]
                at = pa.array(owner[picked])
                columns = [batch.column(k).take(at) for k in (0, 1, 3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(flat[picked]), *columns], ["value", "rep", "n", "x", "y"])

        return run

    number = lambda c: T.StructField(c, T.LongType())
    rows = classes.select("rep", "n", "sketch", "x", "y")
    many = rows.mapInArrow(prefixes(None), T.StructType([number("value")])).groupBy("value").count().where("count > 1")
    many = cut(many.select("value", F.col("value").bitwiseAND(F.lit(BITS - 1)).alias("bit")))
    wanted = spark.sparkContext.broadcast(_filter(many, "bit", BITS))
    listed = rows.mapInArrow(prefixes(wanted), T.StructType([number("value"), kind, number("n"), number("x"), number("y")]))
    return listed.join(many.select("value"), "value", "left_semi")


def _near_enough(percent: int) -> Column:
    """Whether sizes n, m and marks x, y and v, w of two sets leave room for the similarity."""
    apart = F.bit_count(F.col("x").bitwiseXOR(F.col("v"))) + F.bit_count(F.col("y").bitwiseXOR(F.col("w")))
    return (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (apart <= FAR)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose similarity, estimated on the k smallest hashes of the union, may be enough."""
    own = classes.select("rep", "sketch")
    both = pairs.join(own.select(F.col("rep").alias("a"), F.col("sketch").alias("s")), "a").join(own.select(F.col("rep").alias("b"), F.col("sketch").alias("t")), "b")
    union = F.slice(F.array_sort(F.array_union("s", "t")), 1, K)
    seen = both.select("a", "b", "s", "t", union.alias("union")).select("a", "b", F.size("union").alias("size"), F.size(F.array_intersect(F.array_intersect("s", "t"), "union")).alias("common"))
    return seen.where(F.col("common") * K >= NEED * F.col("size")).select("a", "b").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """Rows (key, set): the full sets, as bytes, of the documents with a ``key`` in ``wanted``, computed from the whole texts."""
    wanted = wanted.select("key").distinct()
    # A filter of fixed size keeps most other documents out of the shuffle; the join decides.
    bit = F.pmod(F.xxhash64("key"), F.lit(BITS))
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted.select(bit.alias("bit")), "bit", BITS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, shingle = shared.value, Shingler(width)
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            inside = np.flatnonzero(_inside(filter_, at))
            some = batch.take(pa.array(inside))
            for k in range(0, len(some), 500):
                part = some.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], ["key", "set"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL").withColumn("bit", bit)
    full = rows.mapInArrow(sets, T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("set", T.BinaryType())]))
    return full.join(wanted, "key", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    full = _sets(docs, pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))), width, key, text)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(x.as_py(), np.int64) for x in (one, two))
                at = np.searchsorted(s, t)
                common = int((s[np.minimum(at, len(s) - 1)] == t).sum()) if len(s) else 0
                keep.append(common > 0 and 100 * common >= percent * (len(s) + len(t) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    kind = docs.schema[key].dataType
    both = pairs.join(full.withColumnsRenamed({"key": "a", "set": "s"}), "a").join(full.withColumnsRenamed({"key": "b", "set": "t"}), "b")
    return both.select("a", "b", "s", "t").mapInArrow(check, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).distinct()


def _overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set with each of the others; elements of one set only are left out first."""
    every = [*sets, *others]
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    _, at, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    use = count[at] > 1
    owner, at = owner[use], (np.cumsum(count > 1) - 1)[at[use]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((len(sets), len(others)), np.float32)
    edges = np.searchsorted(at, np.arange(0, int(at[-1]) + 1 + STRIPE, STRIPE)) if len(at) else []
    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        held = np.zeros((len(every), STRIPE), np.float32)
        held[owner[low:high], at[low:high] - k * STRIPE] = 1
        common += held[: len(sets)] @ held[len(sets) :].T
    return common


def compared(rest: DataFrame, docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """The similar pairs (a, b) of different components among all that share a list in ``rest``.

    Lists with the same smallest member are taken together.  Each such bundle is dealt to blocks of
    bounded size, and a task compares two blocks; a full set is shipped once for each block of its
    bundle, not for each pair.
    """
    kind = docs.schema[key].dataType
    heads = rest.groupBy("value").agg(F.min("rep").alias("head"))
    bundles = cut(rest.join(heads, "value").select("head", "rep", "component", "n").distinct())
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_VALUES)).cast("int")
    blocks = bundles.groupBy("head").agg(size.alias("blocks"), F.count_distinct("component").alias("parts")).where("parts > 1").select("head", "blocks")
    members = bundles.join(blocks, "head").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    full = _sets(docs, members.select(F.col("rep").alias("key")), width, key, text)
    rows = members.join(full.withColumnRenamed("key", "rep"), "rep")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = rows.select("head", "i", "j", "block", "rep", "component", "set")
    # By number, so that small partitions of much work are not put together.
    rows = rows.repartition(partitions(docs.sparkSession), "head", "i", "j").sortWithinPartitions("head", "i", "j")

    def pairs(group: list[tuple]) -> pa.RecordBatch:
        i, j = group[0][1], group[0][2]
        ones, twos = [g for g in group if g[3] == i], [g for g in group if g[3] == j]
        sets, others = ([np.frombuffer(g[6], np.int64) for g in side] for side in (ones, twos))
        sizes = np.array([len(s) for s in sets])[:, None] + np.array([len(s) for s in others])[None, :]
        common = _overlaps(sets, others).astype(np.int64)
        x, y = np.nonzero((common > 0) & (100 * common >= percent * (sizes - common)))
        found = {(min(ones[p][4], twos[q][4]), max(ones[p][4], twos[q][4])) for p, q in zip(x.tolist(), y.tolist(), strict=True) if ones[p][5] != twos[q][5]}
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], to_arrow_type(kind)) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    yield pairs(group)
                    group = []
                group.append(row)
        if group:
            yield pairs(group)

    return rows.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, body, n_shingles, component_id, kept), one per document; the bounds hold for 80 percent and above only.

    ``body`` is xxhash64 of the text, which tells rows of one id apart.
    """
    if percent < 80:
        raise ValueError(f"percent has to be at least 80, as NEED and FAR are bounds for that: {percent}")
    wide = cut(sketches(docs, width, key, text))
    table = cut(wide.select("key", "body", "n", "digest"))
    classes = wide.where("n > 0 AND key IS NOT NULL").groupBy("digest", "n", "sketch", "x", "y").agg(F.min("key").alias("rep"))
    classes = cut(classes)
    del wide
    lists = cut(postings(classes, percent))
    links, named = None, lists.withColumn("component", F.col("rep"))
    for turn in range(STAR_ROUNDS + 1):
        # Lists that hold more than one component, and how many pairs are still apart in them.
        parts = named.groupBy("value", "component").agg(F.count("*").alias("part"))
        open_ = parts.groupBy("value").agg(F.sum("part").alias("all"), F.sum(F.col("part") * F.col("part")).alias("squares"), F.count("*").alias("parts")).where("parts > 1")
        total = open_.agg(F.sum("all").alias("rows"), F.sum((F.col("all") * F.col("all") - F.col("squares")) / 2).alias("apart")).first()
        if not total["rows"]:
            break
        last = turn > 0 and (total["apart"] <= AT_ONCE * total["rows"] or turn == STAR_ROUNDS)
        rest = named.join(open_.select("value"), "value", "left_semi")
        if last:
            # Only members that have another, of a different component, near them in the list.
            other = rest.select("value", F.col("n").alias("m"), F.col("component").alias("c"), F.col("x").alias("v"), F.col("y").alias("w"))
            one, two = rest.alias("one"), other.alias("two")
            near = cut(one.join(two, (F.col("one.value") == F.col("two.value")) & (F.col("component") != F.col("c")) & _near_enough(percent), "left_semi"))
            found = cut(compared(near, docs, width, percent, key, text))
        else:
            order = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
            heads = rest.groupBy("value").agg(F.min(F.struct(order.alias("o"), F.col("rep").alias("b"), F.col("n").alias("m"), F.col("component").alias("c"), F.col("x").alias("v"), F.col("y").alias("w"))).alias("head")).select("value", "head.*")
            pairs = rest.join(heads, "value").where((F.col("component") != F.col("c")) & _near_enough(percent))
            pairs = pairs.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b"))
            found = cut(confirmed(cut(_likely(pairs.distinct(), classes)), docs, width, percent, key, text))
        links = found if links is None else links.unionByName(found)
        groups = components(links).select(F.col("node").alias("rep"), F.col("component").alias("merged"))
        if last:
            break
        named = lists.join(groups, "rep", "left").select(*lists.columns, F.coalesce("merged", "rep").alias("component"))
    reps = classes.select("digest", "n", "rep")
    if links is not None:
        reps = reps.join(groups, "rep", "left").select("digest", "n", F.coalesce("merged", "rep").alias("component"))
    else:
        reps = reps.select("digest", "n", F.col("rep").alias("component"))
    # Rows that repeat an id share its smallest component.
    named = table.select("key", "body", "n", "digest").join(reps, ["digest", "n"], "left")
    return named.select(
        F.col("key").alias(key),
        "body",
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component_id"),
        F.coalesce(F.col("key") == F.coalesce("component", "key"), F.lit(True)).alias("kept"),
    )
