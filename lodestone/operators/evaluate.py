"""Metrics of rankings, splits and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import store

TOPS = (1, 10, 100)


def precision(position: Column, n: int) -> Column:
    """Share of positions up to n; 0 without any."""
    return F.coalesce(F.avg((position <= n).cast("double")), F.lit(0.0))


def mean_reciprocal_rank(position: Column) -> Column:
    return F.coalesce(F.avg(1.0 / position), F.lit(0.0))


def report(solutions: DataFrame, tops: Sequence[int] = TOPS, by: str = "method", decimals: int = 6) -> DataFrame:
    """(by, answers, p_<n>..., mrr)."""
    columns = [F.round(precision(F.col("position"), n), decimals).alias(f"p_{n}") for n in tops]
    return solutions.groupBy(by).agg(F.count("*").alias("answers"), *columns, F.round(mean_reciprocal_rank(F.col("position")), decimals).alias("mrr"))


def long_report(wide: DataFrame, tops: Sequence[int] = TOPS, by: str = "method") -> DataFrame:
    """(by, metric, value)."""
    names = [*(f"p_{n}" for n in tops), "mrr"]
    return wide.unpivot([by], names, "metric", "value")


def split(items: DataFrame, shares: Sequence[int], by: str) -> DataFrame:
    """items with `part` 0, 1, ...: consecutive shares by id; sizes round half to even, the last part takes the rest.

    Only the number of items comes to the driver; places come from counts of ranges, not from one sorted task.
    """
    total, whole = items.count(), sum(shares)
    ends, at = [], 0
    for share in shares[:-1]:
        at += round(total * share / whole)
        ends.append(at)
    placed = with_place(items, by)
    part = F.lit(len(ends))
    for i in reversed(range(len(ends))):
        part = F.when(F.col("__place") < ends[i], i).otherwise(part)
    return placed.withColumn("part", part).drop("__place")


def with_place(items: DataFrame, by: str, bins: int = 256) -> DataFrame:
    """items with `__place`, the place from 0 in the order of a column.

    Rows go to ranges that hold about as many rows each, whatever the values; a range is numbered by itself and shifted by
    the counts of those before it.  Ranges are kept in the shared folder, so that both steps see the same.
    """
    binned = store(items.repartitionByRange(bins, by).withColumn("__bin", F.spark_partition_id()), "ranges")
    counts = binned.groupBy("__bin").agg(F.count("*").alias("n"))
    before = counts.select("__bin", (F.sum("n").over(Window.orderBy("__bin")) - F.col("n")).alias("before"))  # at most `bins` rows
    inside = F.row_number().over(Window.partitionBy("__bin").orderBy(by)) - 1
    return binned.withColumn("__in", inside).join(F.broadcast(before), "__bin").withColumn("__place", F.col("before") + F.col("__in")).drop("__bin", "__in", "before")


def leading_run(positions: DataFrame, by: str = "question_id") -> DataFrame:
    """(by, run, n): how many positions 1, 2, ... up to 9 are there without a gap, and how many there are."""
    sets = positions.groupBy(by).agg(F.collect_set(F.when(F.col("position") <= 10, F.col("position"))).alias("have"), F.count_distinct("position").alias("n"))
    missing = F.filter(F.sequence(F.lit(1), F.lit(10)), lambda i: ~F.array_contains("have", i))
    return sets.select(by, F.least(F.array_min(missing) - 1, F.lit(9)).alias("run"), "n")


def leading_run_p1(positions: DataFrame, by: str = "question_id") -> DataFrame:
    return leading_run(positions, by).agg(F.coalesce(F.sum("run") / F.sum("n"), F.lit(0.0)).alias("p1"))


def accuracy(prediction: Column, target: Column, threshold: float = 0.5) -> Column:
    return F.avg(((prediction > threshold).cast("int") == target).cast("double"))


def text_report(report: DataFrame, smaller: DataFrame, title: str, tops: Sequence[int] = TOPS, width: int = 60) -> str:
    """A table in fixed width of a report (method, answers, p_<n>..., mrr): one line a method, by name, with the sign of
    its better direction.  smaller: (method, is_smaller_first).  Methods are few, as are their lines.
    """
    head = f"{title:<{width}}       #" + "".join(f"{t:>8}" for t in tops) + "     MRR"
    lines = [head]
    for r in sorted(report.join(smaller, "method", "left").collect(), key=lambda r: r["method"]):
        scores = "".join(f"{r[f'p_{t}']:>8.4f}" for t in tops) + f"{r['mrr']:>8.4f}"
        lines.append(f"{'<' if r['is_smaller_first'] else '>'} {r['method']:<{width - 2}} {r['answers']:>7}{scores}")
    return "\n".join(lines)


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of tables."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
