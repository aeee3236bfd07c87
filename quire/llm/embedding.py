"""Operator 3: near-duplicate vectors by Euclidean p-stable hashing.

Vectors of one label are normalised and projected on random Gaussian directions; the projections,
shifted and cut into steps of ``STEP``, form a bucket in each of several tables.  At cosine 0.98
two unit vectors are at most 0.2 apart and fall into one step with probability 0.867.  The number of
projections per table grows with the logarithm of the number of vectors, so that buckets stay
small, and the number of tables with it, so that a pair at the threshold is missed in all tables
with probability MISS at most.  Vectors that share a bucket are compared exactly, in double
precision, in blocks; a pair counts only in the first table whose bucket it shares.

Equal vectors are one class from the start and count with their number.  Buckets are counted on
rows of three numbers; a vector is sent, as wide as its column holds it, only to the buckets that it
shares, and normalised where it is compared.  A bucket of more than ``BLOCK`` classes is dealt to pairs of blocks, so no task holds more than two blocks, and a block
returns link counts and a spanning forest, never its pairs.

Vectors link only under equal, non-null labels and with equally many components.  Null, empty or
zero vectors and those with null or non-finite components link with nothing, nor do rows with a
null id (null component).  Rows that repeat an id count as vectors of their own and share its
component.  Only the three named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import cut
from quire.llm.components import components

STEP = 1.2
MISS = 0.001
BLOCK = 2000
SEED = 20


def collision(distance: float) -> float:
    """Probability that one projection puts two points so far apart into one step."""
    r = STEP / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(vectors: int, cosine: float) -> tuple[int, int]:
    """Projections per table, and tables, for so many vectors."""
    per_table = min(24, max(4, math.ceil(math.log(max(vectors, 2) / 1000, 1 / collision(math.sqrt(2))) + 1) if vectors > 1000 else 4))
    hit = collision(math.sqrt(2 - 2 * cosine)) ** per_table if cosine < 1 else 1 - 1e-12
    return per_table, max(1, math.ceil(math.log(MISS) / math.log(1 - hit)))


def _rows(column) -> Iterator[np.ndarray | None]:
    """Each vector in double precision; None for those that link with nothing."""
    values = column.flatten() if column.null_count == 0 else pa.array([], column.type.value_type)
    if column.null_count or values.null_count:
        for x in column:
            v = x.as_py()
            yield None if v is None or any(c is None for c in v) else _usable(np.array(v, np.float64))
        return
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    ends = column.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield _usable(flat[a:b])


def _usable(v: np.ndarray) -> np.ndarray | None:
    with np.errstate(over="ignore", invalid="ignore"):
        return v if len(v) and np.isfinite(v).all() and v.any() else None


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / math.sqrt(float(v @ v))


def _width(df: DataFrame, vector: str) -> type:
    """The type that holds the components without loss in the fewest bytes."""
    return np.float32 if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else np.float64


def _unpacked(packed: bytes, width: type) -> np.ndarray:
    return _unit(np.frombuffer(packed, width).astype(np.float64))


def _classed(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows (key, c, label, v): class number and packed vector, null for what links with nothing."""
    width = _width(df, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, packed = [], []
            for v, name, lost in zip(_rows(batch.column(1)), batch.column(2).to_pylist(), batch.column(0).is_null().to_pylist(), strict=True):
                if v is None or name is None or lost:
                    numbers.append(None)
                    packed.append(None)
                else:
                    mark = hashlib.blake2b(f"{name!r} ".encode() + v.tobytes(), digest_size=8).digest()
                    numbers.append(int.from_bytes(mark, "little", signed=True))
                    packed.append(v.astype(width).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.int64()), batch.column(2), pa.array(packed, pa.binary())], ["key", "c", "label", "v"]
            )

    fields = [T.StructField("key", df.schema[key].dataType), T.StructField("c", T.LongType()), T.StructField("label", df.schema[label].dataType), T.StructField("v", T.BinaryType())]
    return df.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label")).mapInArrow(run, T.StructType(fields))


def _hashed(classes: DataFrame, per_table: int, tables: int, width: type) -> DataFrame:
    """Rows (c, rep, mult, v, buckets): one bucket number per table, of label, size and steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            buckets = []
            for name, packed in zip(batch.column(4).to_pylist(), batch.column(3), strict=True):
                v = _unpacked(packed.as_py(), width)
                if len(v) not in known:
                    draw = np.random.default_rng([SEED, len(v)])
                    known[len(v)] = draw.standard_normal((len(v), tables * per_table)), draw.random(tables * per_table) * STEP, draw.integers(1, 1 << 62, tables * per_table) | 1
                directions, shifts, odd = known[len(v)]
                steps = np.floor((v @ directions + shifts) / STEP).astype(np.int64)
                salt = int.from_bytes(hashlib.blake2b(f"{name!r} {len(v)}".encode(), digest_size=8).digest(), "little", signed=True)
                with np.errstate(over="ignore"):
                    buckets.append((steps * odd).reshape(tables, per_table).sum(axis=1) + np.int64(salt))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(buckets, pa.list_(pa.int64()))], ["c", "rep", "mult", "v", "buckets"])

    fields = [*(classes.schema[c] for c in ("c", "rep", "mult", "v")), T.StructField("buckets", T.ArrayType(T.LongType()))]
    return classes.select("c", "rep", "mult", "v", "label").mapInArrow(run, T.StructType(fields))


def _compare(rows: list[tuple], cosine: float, width: type) -> list[tuple]:
    """(c, rep, links, root) of the classes of one block pair that have links in it."""
    unit = np.stack([_unpacked(r[5], width) for r in rows])
    buckets = np.array([r[6] for r in rows])
    table, (low, high) = rows[0][0], (rows[0][2], rows[0][3])
    side = np.array([r[7] for r in rows])
    number, mult, reps = [r[8] for r in rows], np.array([r[9] for r in rows]), [r[4] for r in rows]
    links, root = np.zeros(len(rows), np.int64), list(range(len(rows)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    first, second = (np.arange(len(rows)),) * 2 if low == high else (np.flatnonzero(side == low), np.flatnonzero(side == high))
    for k in range(0, len(first), 256):
        own = first[k : k + 256]
        i, j = np.nonzero(unit[own] @ unit[second].T >= cosine)
        i, j = own[i], second[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        if table:  # already met in an earlier table?
            new = ~(buckets[i, :table] == buckets[j, :table]).any(axis=1)
            i, j = i[new], j[new]
        np.add.at(links, i, mult[j])
        np.add.at(links, j, mult[i])
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                a, b = (a, b) if (reps[a], a) < (reps[b], b) else (b, a)
                root[b] = a
    return [(number[k], reps[k], int(links[k]), reps[top(k)]) for k in np.flatnonzero(links).tolist()]


def _linked(dealt: DataFrame, cosine: float, kind, width: type) -> DataFrame:
    """Compare within each (t, bucket, low, high) of rows that are sorted by it."""
    names = ["c", "rep", "links", "root"]

    def table(done: list[tuple], types) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], types[k]) for k in range(4)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key, done, types = [], None, [], None
        for batch in batches:
            types = types or [pa.int64(), batch.schema.field("rep").type, pa.int64(), batch.schema.field("rep").type]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != key:
                    if len(group) > 1:
                        done += _compare(group, cosine, width)
                    group, key = [], row[:4]
                group.append(row)
            if len(done) > 10_000:
                yield table(done, types)
                done = []
        if len(group) > 1:
            done += _compare(group, cosine, width)
        if done:
            yield table(done, types)

    fields = [T.StructField("c", T.LongType()), T.StructField("rep", kind), T.StructField("links", T.LongType()), T.StructField("root", kind)]
    return dealt.mapInArrow(run, T.StructType(fields))


def near_vectors(df: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows (key, n_links, component_id, kept), one per vector."""
    table = cut(_classed(df, key, vector, label))
    classes = cut(
        table.where("c IS NOT NULL").groupBy("c").agg(F.min("key").alias("rep"), F.count("*").alias("mult"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    )
    per_table, tables = shape(classes.count(), cosine)
    width = _width(df, vector)
    hashed = cut(_hashed(classes, per_table, tables, width))
    listed = hashed.select("c", F.posexplode("buckets").alias("t", "bucket"))
    sizes = listed.groupBy("t", "bucket").count().where("count > 1")
    sizes = cut(sizes.select("t", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    # At most one entry for each table.
    shared = listed.join(sizes, ["t", "bucket"]).groupBy("c").agg(F.collect_list(F.struct("t", "bucket", "blocks")).alias("met"))
    dealt = (
        hashed.join(shared, "c")
        .select("c", "rep", "mult", "v", "buckets", F.inline("met"))
        .withColumn("buckets", F.slice("buckets", F.lit(1), F.col("t")))  # the tables before
        .withColumn("side", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("t", "bucket", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "rep", "v", "buckets", "side", "c", "mult")
        .repartition("t", "bucket", "low", "high")
        .sortWithinPartitions("t", "bucket", "low", "high")
    )
    linked = cut(_linked(dealt, cosine, table.schema["key"].dataType, width))
    counts = linked.groupBy("c").agg(F.sum("links").alias("links"))
    groups = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (
        classes.select("c", "rep", "mult").join(counts, "c", "left").join(groups, F.col("rep") == F.col("node"), "left")
        .select("c", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    out = table.select("key", "c").join(named, "c", "left")
    mine = F.coalesce("component", "key")
    return out.select(
        F.col("key").alias(key),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        mine.alias("component_id"),
        F.coalesce(F.col("key") == mine, F.lit(True)).alias("kept"),
    )
