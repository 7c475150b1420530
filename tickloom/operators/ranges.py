"""Byte ranges: adjacent ranges merged, and reads that bridge small gaps within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import ordered_scan

# fixed values: limits of one read plan
MAX_GAP, GAP_BUDGET, CHUNK = 65_536, 262_144, 1_048_576


def adjacent_ranges(pieces: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, first, offset, length, pieces): neighbours in order of which one ends where the next starts."""
    w = Window.partitionBy(*key).orderBy(order)
    joins = F.lag(F.col("offset") + F.col("length")).over(w) == F.col("offset")
    numbered = pieces.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return numbered.groupBy(*key, "_run").agg(F.min(order).alias("first"), F.min("offset").alias("offset"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("pieces")).drop("_run")


def gap_budget_reads(pieces: DataFrame, key: list[str], order: str, max_gap: int = MAX_GAP, budget: int = GAP_BUDGET, chunk: int = CHUNK) -> DataFrame:
    """(key, read, start, end, pieces): a piece joins the read before it if it lies after it, the gap is at most max_gap, all gaps so
    far and this one keep within budget, and the read within chunk; a piece longer than chunk is read alone.

    What joins depends on what joined before, so each key's pieces are scanned in order; the state is the open read.
    """

    def step(state, row):
        if row is None:
            return None, [state[:4]] if state else []
        a, n = row
        b = a + n
        if state is None:
            return (0, a, b, 1, n <= chunk, 0), []
        read, start, end, count, open_, spent = state
        if open_ and 0 <= a - end <= max_gap and spent + a - end <= budget and b - start <= chunk:
            return (read, start, b, count + 1, True, spent + a - end), []
        return (read + 1, a, b, 1, n <= chunk, spent), [state[:4]]

    return ordered_scan(pieces, key, order, ["offset", "length"], step, [(n, "bigint") for n in ("read", "start", "end", "pieces")])
