"""Operator 5 [native]: benchmark decontamination by a prefix-filtered set join.

Texts are sequences of words (A-Z lower-cased; runs of ASCII letters and digits and of anything
beyond ASCII).  A window is ``width`` consecutive words of an item, or all of a shorter item.  A
document contains a window if its words occur there in order, next to each other.

Windows are sets of three-word shingles with their places (a window of one or two words is one
shingle).  All shingles of documents that some item has are found in one pass, by a hash and then
word by word.  Their counts order each window's shingles by rarity; containment of a whole window
needs each of its shingles, so its rarest one is prefix enough.  A document's match of a window's
prefix fixes where the window would begin (positional bound) and end (length bound), and the
window is verified there against the document's other matches, by a join on place and shingle, so
no document's matches are gathered in one task.

Null and empty texts have no words.  Documents are told apart by a hash of id and text, so null and
repeated ids are separate rows, and rows that repeat both have the same result.  An empty table gives
an empty result.  A very long text is one row while its words are taken, and is spread out after.  Null item ids stand for the empty string in the digest; equal windows of several
items count for each.  Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut

# What the contract takes as words, after lower-casing A-Z.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Shingles of all items that may be broadcast (about 100 bytes each); beyond it they are shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text; ``lower`` is right, and faster, where all is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def _shingles(column: str, size: int) -> Column:
    """All runs of ``size`` words as structs a, b, c (null where the size is smaller)."""
    n = F.size(column)
    parts = [F.slice(column, k + 1, F.greatest(n - (size - 1), F.lit(0))) for k in range(size)]
    zipped = F.arrays_zip(*[p.alias(c) for p, c in zip(parts, "abc", strict=False)])
    kind = "array<struct<" + ",".join(f"{c}:string" for c in "abc"[:size]) + ">>"
    zipped = zipped.cast(kind)
    if size == 3:
        return zipped
    return F.transform(zipped, lambda x: F.struct(x["a"].alias("a"), (x["b"] if size > 1 else F.lit(None).cast("string")).alias("b"), F.lit(None).cast("string").alias("c")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find(docs: DataFrame, items: DataFrame, width: int = 13, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (key, row, n_words, n_hit, item_ids): words in occurring windows and the sorted items they are of.

    ``row`` is xxhash64 of id and text: rows that repeat both have the same result.
    """
    # Windows, each distinct sequence once, with their items.
    asked = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    begins = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    windows = (
        asked.select("item", "w", F.explode(begins).alias("at"))
        .select("item", F.slice("w", F.col("at"), width).alias("w"))
        .groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select("w", "items", F.xxhash64("w").alias("window"), F.size("w").alias("n"))
    )
    windows = cut(windows)
    lists = F.when(F.col("n") >= 3, _shingles("w", 3)).when(F.col("n") == 2, _shingles("w", 2)).otherwise(_shingles("w", 1))
    placed = windows.select("window", "n", F.posexplode(lists).alias("off", "s")).select("window", "n", "off", "s.*")
    known = placed.select("a", "b", "c").distinct().withColumn("sid", F.xxhash64("a", "b", "c"))
    # A row for each document, whatever it holds: a mark that no word can be.
    mark = items.sparkSession.range(1).select(F.lit("\n").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("c"))
    mark = mark.withColumn("sid", F.xxhash64("a", "b", "c"))
    totals = placed.agg(F.count("*").alias("rows"), F.bool_or(F.col("n") == 1).alias("one"), F.bool_or(F.col("n") == 2).alias("two")).first()

    table = docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("row"), words(F.col(text)).alias("w"))
    sizes = [3, *([1] if totals["one"] else []), *([2] if totals["two"] else [])]
    first = F.array(F.struct(F.lit("\n").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("c")))
    every = None
    for size in sizes:
        own = _shingles("w", size)
        own = F.concat(first, own) if size == 3 else own
        part = table.select("key", "row", F.size("w").alias("n_words"), F.posexplode(own).alias("pos", "s"))
        part = part.select("key", "row", "n_words", (F.col("pos") - (1 if size == 3 else 0)).alias("pos"), "s.*")
        every = part if every is None else every.unionByName(part)
    every = every.withColumn("h", F.xxhash64("a", "b", "c"))
    wanted = known.select(*[F.col(c).alias(f"_{c}") for c in "abc"], "sid")
    same = (F.col("h") == F.col("sid")) & (F.col("a") == F.col("_a")) & F.col("b").eqNullSafe(F.col("_b")) & F.col("c").eqNullSafe(F.col("_c"))
    columns = ["key", "row", "n_words", "pos", "sid"]
    if totals["rows"] <= BROADCAST_ROWS:
        both = wanted.unionByName(mark.select(*[F.col(c).alias(f"_{c}") for c in "abc"], "sid"))
        matches = every.join(F.broadcast(both), same).select(columns)
    else:
        marked = every.where("pos < 0").withColumn("sid", F.col("h")).select(columns)
        matches = every.where("pos >= 0").join(wanted, same).select(columns).unionByName(marked)
    matches = cut(matches)
    found = matches.where("pos >= 0").select("row", "pos", "sid")

    # Rarest shingle of each window first; ties by place.
    frequency = found.groupBy("sid").agg(F.count("*").alias("frequency"))
    placed = placed.withColumn("sid", F.xxhash64("a", "b", "c")).select("window", "n", "off", "sid")
    prefix = (
        placed.join(frequency, "sid")  # a shingle that no document has rules its windows out
        .groupBy("window", "n")
        .agg(F.count("*").alias("present"), F.min(F.struct("frequency", "off", "sid")).alias("rarest"))
        .where(F.col("present") == F.greatest(F.col("n") - 2, F.lit(1)))
        .select("window", "n", "rarest.off", "rarest.sid")
    )
    candidates = (
        found.join(_small(prefix, totals["rows"]), "sid")
        .select("row", (F.col("pos") - F.col("off")).alias("first"), "window", "n")
        .where("first >= 0")
    )
    # Verify: every shingle of the window has to be among the document's matches in its place.
    asked = candidates.join(_small(placed.select("window", "off", "sid"), totals["rows"]), "window")
    asked = asked.select("row", "window", "n", "first", (F.col("first") + F.col("off")).alias("pos"), "sid").distinct()
    there = asked.join(found, ["row", "pos", "sid"], "left_semi").groupBy("row", "window", "n", "first").count()
    checked = cut(there.where(F.col("count") == F.greatest(F.col("n") - 2, F.lit(1))).select("row", "window", "n", "first"))
    covered = checked.select("row", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("p")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = checked.select("row", "window").distinct().join(_small(windows.select("window", "items"), totals["rows"]), "window")
    named = named.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    hits = covered.join(named, "row")
    return (
        matches.where("pos < 0").select("key", "row", F.col("n_words").cast("long").alias("n_words"))
        .join(hits, "row", "left")
        .select(F.col("key").alias(key), "row", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    )


def contaminated() -> Column:
    """Whether hit words are a twentieth of all, or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(
        key,
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
