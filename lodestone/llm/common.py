"""What the operators of this subpackage share: tables, running sums in a row, joins on hot keys and bounded batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scope, store

__all__ = ["bounded_batches", "fresh", "furthest", "let", "only", "page_range", "pages", "partitions", "running", "scope", "store", "table", "with_unique"]

#: Bytes of an Arrow batch sent to a Python worker, and rows at most.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000
#: A key is hot if it holds more rows than a share of this of what a partition would get.
HOT_SHARE = 8
#: Elements of an array that are summed up together, and how often totals of such blocks are blocked again.
BLOCK, LEVELS = 32, 3
#: Code points of a text that are cut from it together.
PAGE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once, so that very long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_held: dict[str, dict] = {}


def only(operator: str, held: dict | None = None) -> None:
    """Called by a worker's task: from now on the worker remembers things of this operator alone, those in `held`.

    Spark gives a worker tasks of one stage after another; without this it would hold what every operator remembers.
    """
    others = [x for x in _held if x != operator]
    for x in others:
        _held.pop(x).clear()
    if others and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
    if held is not None:
        _held[operator] = held


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """The names wanted, each with underscores after it until no column has it, whatever the letter case."""
    have, out = {x.lower() for x in taken}, []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, levels: int = LEVELS) -> Column:
    """For each of an array of longs, the sum of those before it.

    Blocks of BLOCK are summed by themselves and shifted by the sums of the blocks before, found the same way; so the
    work grows with the array's length, and no array is built by appending but one of length / BLOCK ** levels.
    """
    zero = F.lit(0).cast("long")
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)

    def appended(v: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(v, start, step)["out"]

    def shifted(block: Column, by: Column) -> Column:
        return F.transform(block, lambda x, i: by + total(F.slice(block, F.lit(1), i)))

    def blocked(v: Column) -> Column:
        number = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        blocks = F.transform(number, lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        whole = let(blocks, lambda bs: F.flatten(F.zip_with(bs, running(F.transform(bs, total), levels - 1), shifted)))
        return F.when(F.size(v) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(values, blocked if levels else appended)


def furthest(values: Column, levels: int = LEVELS) -> Column:
    """For each of an array of integers, the greatest of those before it, -1 where there is none; blocked as in running."""
    none = F.lit(-1)
    most = lambda xs: F.coalesce(F.array_max(xs), none)

    def appended(v: Column) -> Column:
        return F.transform(v, lambda x, i: most(F.slice(v, F.lit(1), i)))

    def shifted(block: Column, by: Column) -> Column:
        return F.transform(block, lambda x, i: F.greatest(by, most(F.slice(block, F.lit(1), i))))

    def blocked(v: Column) -> Column:
        number = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        blocks = F.transform(number, lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        whole = let(blocks, lambda bs: F.flatten(F.zip_with(bs, furthest(F.transform(bs, most), levels - 1), shifted)))
        return F.when(F.size(v) > 0, whole).otherwise(F.array().cast("array<int>"))

    return let(values, blocked if levels else appended)


def pages(text: Column) -> Column:
    """text in pieces of PAGE code points, for page_range."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def page_range(cut: Column, start: Column, end: Column) -> Column:
    """Code points start (from 0) to end of a text in pages: what it takes doesn't depend on where in the text they are."""
    first, last = F.floor(start / PAGE).cast("int"), F.floor(end / PAGE).cast("int")
    begin, stop = (start - first * PAGE).cast("int"), (end - last * PAGE).cast("int")
    one = F.substr(F.coalesce(F.get(cut, first), F.lit("")), begin + 1, F.greatest(stop - begin, F.lit(0)))
    tail = F.substr(F.coalesce(F.get(cut, last), F.lit("")), F.lit(1), stop)
    more = F.concat(F.substr(F.coalesce(F.get(cut, first), F.lit("")), begin + 1), F.array_join(F.slice(cut, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), tail)
    return F.when(end <= start, "").when(first == last, one).otherwise(more)


def with_unique(left: DataFrame, right: DataFrame, key: str, n: int) -> DataFrame:
    """left joined to right, which has at most one row a key, however many rows of left share a key.

    Keys with more than 1 / (HOT_SHARE * n) of left's rows, of which there are fewer than HOT_SHARE * n, and right's
    rows for them are sent to every task, so their rows stay where they are; all others are exchanged by key.  n is the
    number of partitions that keys are dealt to.  Both tables are read more than once and should be stored ones.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("__n"))
    least = max(1, left.count() // (HOT_SHARE * n))
    hot = [r[0] for r in counts.where(F.col("__n") > least).select(key).collect()]
    if not hot:
        return left.join(right, key)
    session = left.sparkSession
    hot_keys = F.broadcast(session.createDataFrame([(k,) for k in hot], f"{key} {dict(left.dtypes)[key]}"))
    few = F.broadcast(right.join(hot_keys, key, "left_semi"))
    return left.join(few, key).unionByName(left.join(hot_keys, key, "left_anti").join(right, key))
