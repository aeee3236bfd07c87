"""The front ends' small relational operations, on whole corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.native import cell_kind, trim_space


def modal(df: DataFrame, keys: list[str], value: str, largest: bool = True) -> DataFrame:
    """The most frequent value per key; on a tie the largest (or smallest)."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    tie = F.col(value) if largest else -F.col(value)
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("_n", tie)).alias(value))


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the first by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    held = F.min(F.struct(F.col(order).alias("_o"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(rest)])).alias("_row")
    return df.groupBy(*keys).agg(held).select(*keys, *[F.col(f"_row._{k}").alias(c) for k, c in enumerate(rest)])


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element in the middle, the upper one of two."""
    window = Window.partitionBy(*keys)
    ranked = df.withColumn("_r", F.row_number().over(window.orderBy(value))).withColumn("_n", F.count("*").over(window))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*keys, value)


def numbered_slugs(df: DataFrame, keys: list[str], slug: str, order: str) -> DataFrame:
    """Repeated slugs of a key get -1, -2, ... in order."""
    at = F.row_number().over(Window.partitionBy(*keys, slug).orderBy(order)) - 1
    return df.withColumn("fragment", F.when(at == 0, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), at.cast("string"))))


def islands(df: DataFrame, keys: list[str], order: str, number: Column) -> DataFrame:
    """Runs of consecutive numbers: a gap begins a new list."""
    window = Window.partitionBy(*keys).orderBy(order)
    begins = F.coalesce((number != F.lag(number).over(window) + 1).cast("int"), F.lit(1))
    return df.withColumn("island", F.sum(begins).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def dense_cells(cells: DataFrame, sheet: str = "sheet") -> DataFrame:
    """The used rectangle of sparse (sheet, row, col, value): every position, empty ones as ''."""
    box = cells.where("value != ''").groupBy(sheet).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    every = box.select(sheet, F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1").select(sheet, "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    return every.join(cells, [sheet, "row", "col"], "left").select(sheet, "row", "col", F.coalesce("value", F.lit("")).alias("value"))


def header_votes(cells: DataFrame, grid: str = "grid") -> DataFrame:
    """Per grid of (grid, row, col, value) whether row 0 labels the columns, by votes of the columns over 50 rows."""
    sample = cells.where("row BETWEEN 0 AND 50").withColumn("value", trim_space(F.col("value"))).withColumn("kind", cell_kind(F.col("value")))
    body, head = F.col("row") > 0, F.col("row") == 0
    counts = [F.count_if(body & (F.col("kind") == k)).alias(k) for k in ("number", "bool", "date", "text")]
    columns = sample.groupBy(grid, "col").agg(
        F.max(F.when(head, F.col("value"))).alias("label"),
        F.max(F.when(head, F.col("kind"))).alias("label_kind"),
        F.count_if(body).alias("below"),
        F.count_if(body & (F.col("value") != "")).alias("filled"),
        F.collect_set(F.when(body & (F.col("value") != ""), F.lower("value"))).alias("seen"),
        *counts,
    )
    typed = F.coalesce(*[F.when(10 * F.col(k) >= 9 * F.col("filled"), F.lit(k)) for k in ("number", "bool", "date", "text")], F.lit("text"))
    vote = (
        F.when(F.col("filled") == 0, 0)
        .when(typed != "text", F.when(F.col("label_kind") == "text", 1).otherwise(-1))
        .when(F.array_contains("seen", F.lower("label")), -1)
        .otherwise(0)
    )
    voted = columns.withColumn("vote", vote)
    ruled_out = (F.max("below") == 0) | (F.max((F.col("label").isNull() | (F.col("label") == "")) & (F.col("col") > 0))) | (F.count_distinct(F.when(F.col("label") != "", F.lower("label"))) < F.count_if(F.col("label") != ""))
    return voted.groupBy(grid).agg(
        F.count_if(F.col("vote") > 0).alias("for_header"),
        F.count_if(F.col("vote") < 0).alias("for_data"),
        (F.when(ruled_out, 0).when((F.count_if(F.col("vote") != 0) == 0), (F.max(F.length("label")) <= 64).cast("int")).otherwise((F.sum("vote") > 0).cast("int"))).alias("header_rows"),
    )


def in_regions(cells: DataFrame, regions: DataFrame, block: int = 64) -> DataFrame:
    """Cells with the region they lie in: a range join on blocks of rows, not on all pairs."""
    spread = regions.withColumn("_b", F.explode(F.sequence(F.floor(F.col("r0") / block), F.floor(F.col("r1") / block))))
    inside = F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    return cells.withColumn("_b", F.floor(F.col("row") / block)).join(spread, ["sheet", "_b"]).where(inside).drop("_b")
