"""Sinks: appending what isn't there yet, updating and deleting by rewriting, and saving rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def absent(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key isn't in `existing`, one a key."""
    return new.join(existing.select(*key).distinct(), key, "left_anti").dropDuplicates(key)


def append_absent(new: DataFrame, existing: DataFrame, key: list[str], path: str) -> None:
    absent(new, existing, key).write.mode("append").parquet(path)


def updated(df: DataFrame, when: Column, **values: Column) -> DataFrame:
    """df with columns replaced where the predicate holds."""
    return df.withColumns({k: F.when(when, v).otherwise(F.col(k)) for k, v in values.items()})


def with_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions that have an answer."""
    return questions.join(answers, "question_id", "left_semi")


def save_ranking(solutions: DataFrame, rates: DataFrame, method: str, path: str) -> None:
    """Solutions and rates of a method, each as a table partitioned by method; a repeated run replaces its own part.

    Rates are written first: a method counts as solved by its solutions, so a run that is broken off between the two is
    taken up again and writes both.
    """
    for name, df in (("rates", rates), ("solutions", solutions)):
        df.withColumn("method", F.lit(method)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(f"{path}/{name}")
