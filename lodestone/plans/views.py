"""Lists: an order by a named column, descending with a minus before it, and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MISSING = -1e9


def page(rows: DataFrame, order: str, number: int, skip: int, size: int, tie: str) -> DataFrame:
    """Page `number` (from 1): `size` rows after `skip` for each page before it."""
    column = F.col(order.lstrip("-"))
    return rows.orderBy(column.desc() if order.startswith("-") else column.asc(), tie).offset(skip * (number - 1)).limit(size)


def counted_page(rows: DataFrame, order: str, number: int, skip: int, size: int, tie: str) -> DataFrame:
    """A page, with the number of all rows in `total_count`."""
    return page(rows, order, number, skip, size, tie).withColumn("total_count", F.lit(rows.count()))


def question_detail(rates: DataFrame, answers: DataFrame, methods: Sequence[tuple[str, bool]], k: int) -> DataFrame:
    """(question_id, article_id, one column w1, w2, ... a method, place, is_answer): weights of all methods (name, whether
    smaller is better), MISSING where a method has none, in the order of the k-th method (from 1) in its direction.

    Equal weights go by the article's id.
    """
    names = [m for m, _ in methods]
    wide = rates.where(F.col("method").isin(names)).groupBy("question_id", "article_id").pivot("method", names).agg(F.max("weight"))
    filled = wide.select("question_id", "article_id", *[F.coalesce(F.col(f"`{m}`"), F.lit(MISSING)).alias(f"w{i}") for i, m in enumerate(names, 1)])
    key = F.col(f"w{k}")
    order = Window.partitionBy("question_id").orderBy(key.asc() if methods[k - 1][1] else key.desc(), "article_id")
    gold = answers.select("question_id", "article_id", F.lit(True).alias("gold")).distinct()
    placed = filled.withColumn("place", F.row_number().over(order))
    return placed.join(gold, ["question_id", "article_id"], "left").withColumn("is_answer", F.coalesce("gold", F.lit(False))).drop("gold")
