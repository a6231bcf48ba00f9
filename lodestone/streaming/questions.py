"""New questions as a stream: each micro-batch is ranked by a batch model, and what is solved already is left out.

A question is solved for a method once its ranking is in the output.  Spark's checkpoint says which files were taken;
a batch that is run again after a failure finds its questions solved, or writes the same ranking under the same batch
number in place of the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RANKING = "question_id long, article_id long, position long, weight double, method string, batch long"


def question_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 16) -> DataFrame:
    """Questions of parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def rank_stream(questions: DataFrame, rank: Callable[[DataFrame], DataFrame], method: str, out: str, checkpoint: str) -> StreamingQuery:
    """Rank each micro-batch by `rank` (questions -> question_id, article_id, position, weight) and keep it in `out`."""

    def solve(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.schema(RANKING).parquet(out).where((F.col("method") == method) & (F.col("batch") != number)).select("question_id").distinct()
            fresh = batch.join(done, "question_id", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            fresh = batch
        ranked = rank(fresh).select("question_id", "article_id", F.col("position").cast("long").alias("position"), "weight")
        rows = ranked.withColumns({"method": F.lit(method), "batch": F.lit(number).cast("long")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "batch").parquet(out)

    return questions.writeStream.foreachBatch(solve).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rankings(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(RANKING).parquet(out)
