"""Scans whose next step depends on the last, and running totals over one sequence without one task for all."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_scan(df: DataFrame, key: list[str], order: str, columns: list[str], step: Callable, fields: list[tuple[str, str]]) -> DataFrame:
    """(key, fields): step(state, columns' values) -> (state, rows) over each key's rows in order, state None at first; step(state, None) ends a key.

    Rows stream through in Arrow batches, sorted within their partition: what is in memory is a batch and
    one state, however long a key's rows are, and each row costs the same.
    """
    names = [f"_k{i}" for i in range(len(key))] + [f"_c{i}" for i in range(len(columns))]
    chosen = df.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=False)], *[F.col(c).alias(n) for c, n in zip(columns, names[len(key) :], strict=True)], F.col(order).alias("_o"))
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key] + [f"`{n}` {t}" for n, t in fields])

    def run(batches):
        now, state, kinds = None, None, None
        for batch in batches:
            kinds = kinds or [batch.schema.field(i).type for i in range(len(key))]
            out = []
            data = [batch.column(i).to_pylist() for i in range(len(names))]
            for row in zip(*data, strict=True):
                own = row[: len(key)]
                if own != now:
                    if now is not None:
                        out += [(*now, *r) for r in step(state, None)[1]]
                    now, state = own, None
                state, rows = step(state, row[len(key) :])
                out += [(*now, *r) for r in rows]
            yield _batch(out, kinds)
        if now is not None:
            yield _batch([(*now, *r) for r in step(state, None)[1]], kinds)

    def _batch(rows, kinds):
        types = [*kinds, *(pa.type_for_alias({"bigint": "int64", "boolean": "bool"}[t]) for _, t in fields)]
        data = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, types, strict=True)], [*key, *(n for n, _ in fields)])

    placed = chosen.repartition(*names[: len(key)]).sortWithinPartitions(*names[: len(key)], "_o").drop("_o")
    return placed.mapInArrow(run, schema)


def running_before(df: DataFrame, order: list[str], value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """df with the sum of value over all rows before, in order (within by).  Rows go to tasks by ranges of the first order column.

    The ranges' bounds are approximate quantiles, the sums are exact: a range's rows are summed in a task,
    and what comes before a range is a sum over the few ranges.
    """
    by = by or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(order[0], [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    place = F.lit(0)
    for b in sorted(set(bounds)):
        place = place + (F.col(order[0]) > b).cast("int")
    ranged = df.withColumn("_range", place)
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as there are ranges (and keys)
    before = ranged.groupBy(*by, "_range").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(before) if not by else before, [*by, "_range"])
    return joined.withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_range", "_before")


def exact_quantiles(df: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """(by, a column a fraction): the least value whose rank reaches the fraction of the rows.  Distinct values are counted first, then ranked by ranges."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_before(counts, [value], "_n", "_below", by)
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    joined = ranked.join(total, by)
    reached = lambda q: (F.col("_below") + F.col("_n")).cast("double") >= F.lit(q) * F.col("_total")
    return joined.groupBy(*by).agg(*[F.min(F.when(reached(q), F.col(value))).alias(n) for n, q in fractions.items()])
