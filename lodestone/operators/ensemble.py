"""Ensembles of methods: normalised weights, linear scores and an evolutionary search for method weights."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import smaller_first
from ..storage import scope, store, stored
from .ranking import pessimistic_rank

#: Pairs of an answer and an article up to which they are compared directly, not by sorting.
DIRECT = 20_000


def normalised(rates: DataFrame) -> DataFrame:
    """rates (question_id, article_id, method, weight) with `x` in 0..1, larger better, by the greatest weight of the
    question and method; where that is 0 weights stay as they are, and missing or NaN weights are 0.
    """
    weight = F.when(F.isnan("weight"), None).otherwise(F.col("weight"))
    most = F.max(weight).over(Window.partitionBy("question_id", "method"))
    x = F.when(most == 0, weight).when(smaller_first(F.col("method")), 1 - weight / most).otherwise(weight / most)
    return rates.withColumn("x", F.coalesce(x, F.lit(0.0)))


def matching(methods: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), name: str = "method") -> DataFrame:
    """Methods whose name has all of `include` and none of `exclude`, letter case as it stands."""
    for p in include:
        methods = methods.where(F.col(name).contains(p))
    for p in exclude:
        methods = methods.where(~F.col(name).contains(p))
    return methods


def score(rates: DataFrame, weights: DataFrame) -> DataFrame:
    """(question_id, article_id, weight): sum of method weights (method, w) times normalised weights."""
    each = normalised(rates).join(weights, "method")
    return each.groupBy("question_id", "article_id").agg(F.sum(F.col("w") * F.col("x")).alias("weight"))


def dataset(rates: DataFrame, solutions: DataFrame, methods: Sequence[str], worst: int = 100) -> DataFrame:
    """(question_id, article_id, is_gold, one column a method): normalised weights, 0 where a method has none; a gold
    row is left out of methods that rank it below `worst`.
    """
    gold = solutions.select("question_id", "article_id", "method", "position")
    marked = normalised(rates).join(gold, ["question_id", "article_id", "method"], "left")
    kept = marked.where(F.col("position").isNull() | (F.col("position") <= worst))
    wide = kept.groupBy("question_id", "article_id").pivot("method", list(methods)).agg(F.max("x")).na.fill(0.0, list(methods))
    answers = solutions.select("question_id", "article_id", F.lit(True).alias("gold")).distinct()
    return wide.join(answers, ["question_id", "article_id"], "left").withColumn("is_gold", F.coalesce("gold", F.lit(False))).drop("gold")


def fitness(rates: DataFrame, solutions: DataFrame, population: DataFrame) -> DataFrame:
    """(individual, mrr, p1) of all individuals (individual, method, w) in one job, by tie-pessimistic ranks."""
    each = normalised(rates).join(population, "method")
    scores = each.groupBy("individual", "question_id", "article_id").agg(F.round(F.sum(F.col("w") * F.col("x")), 9).alias("weight"))
    key = F.struct("individual", "question_id")
    ranked = scores.withColumn("key", key).withColumn("position", pessimistic_rank(F.col("weight"), "key")).drop("key")
    gold = ranked.join(solutions.select("question_id", "article_id").distinct(), ["question_id", "article_id"], "left_semi")
    runs = gold.groupBy("individual", "question_id").agg(F.collect_set(F.when(F.col("position") <= 10, F.col("position"))).alias("have"), F.count("*").alias("n"), F.sum(1.0 / F.col("position")).alias("r"))
    missing: Column = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long")), lambda i: ~F.array_contains("have", i))
    lead = F.least(F.array_min(missing) - 1, F.lit(9))
    return runs.groupBy("individual").agg((F.sum("r") / F.sum("n")).alias("mrr"), (F.sum(lead) / F.sum("n")).alias("p1"))


def by_question(rates: DataFrame, answers: Sequence[DataFrame], methods: Sequence[str]) -> DataFrame:
    """(question_id, x, golds): normalised weights of a question's articles, method after method for each article, and for
    each of the sets of answers which of the articles it has.  Questions without answers are left out.

    A question is a row: its rates are the best of each method and its answers.
    """
    key = ["question_id", "article_id"]
    each = normalised(rates).where(F.col("method").isin(list(methods)))
    wide = each.groupBy(*key).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("method") == m, F.col("x"))), F.lit(0.0)) for m in methods]).alias("x"))
    marks = None
    for i, a in enumerate(answers):
        mark = a.select(*key, *[F.lit(i == j).alias(f"in{j}") for j in range(len(answers))])
        marks = mark if marks is None else marks.unionByName(mark)
    marks = marks.groupBy(*key).agg(*[F.max(f"in{i}").alias(f"in{i}") for i in range(len(answers))])
    tasks = int(rates.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small table, but much work each time
    rows = wide.join(marks, key, "left").repartition(tasks, "question_id").groupBy("question_id").agg(
        F.collect_list(F.struct("x", F.array(*[F.coalesce(f"in{i}", F.lit(False)) for i in range(len(answers))]).alias("gold"))).alias("rows")
    )
    gold = F.transform("rows", lambda r: r["gold"])
    return rows.where(F.exists(gold, lambda g: F.array_contains(g, True))).select("question_id", F.flatten(F.transform("rows", lambda r: r["x"])).alias("x"), F.flatten(gold).alias("golds"))


def places(x: np.ndarray, gold: np.ndarray, people: np.ndarray) -> np.ndarray:
    """(answer, individual): tie-pessimistic ranks of the answers among a question's articles, as fitness ranks them.

    x: (article, method).  gold: which articles are answers.  people: (individual, method).
    """
    s = x @ people.T * 1e9
    scores = np.copysign(np.floor(np.abs(s) + 0.5), s)  # nine decimals
    mine = scores[gold]
    if mine.shape[0] * len(x) > DIRECT:
        return np.stack([len(x) - np.searchsorted(np.sort(o), m) for o, m in zip(scores.T, mine.T, strict=True)], axis=1)
    at_least = np.zeros(mine.shape, np.int64)
    for i in range(0, len(x), 255):  # counts of a block fit into a byte
        at_least += np.add.reduce((scores[None, i : i + 255] >= mine[:, None]).view(np.uint8), axis=1, dtype=np.uint8)
    return at_least


def mean_ranks(spark: SparkSession, table: DataFrame, which: int, of: int, people: np.ndarray) -> np.ndarray:
    """The MRR of each individual by the answers number `which` of `of` in a table of by_question; 0 without any.

    A task gives one row, whatever it reads.
    """
    n_methods = people.shape[1]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, answers = np.zeros(len(people)), 0
        for batch in batches:
            xs, marks = batch.column(0), batch.column(1)
            x_all, gold_all = xs.flatten().to_numpy(zero_copy_only=False), marks.flatten().to_numpy(zero_copy_only=False)
            x_at, gold_at = (c.offsets.to_numpy() - c.offsets[0].as_py() for c in (xs, marks))
            for a, b, c, d in zip(x_at[:-1], x_at[1:], gold_at[:-1], gold_at[1:], strict=True):
                gold = np.flatnonzero(gold_all[c:d].reshape(-1, of)[:, which])
                if len(gold):
                    total += (1 / places(x_all[a:b].reshape(-1, n_methods), gold, people)).sum(axis=0)
                    answers += len(gold)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([answers])], names=["total", "answers"])

    parts = table.select("x", "golds").mapInArrow(measured, "total array<double>, answers long").collect()
    answers = sum(p["answers"] for p in parts)
    # to twelve decimals, so that the order in which tasks end decides nothing
    return np.round(np.sum([p["total"] for p in parts], axis=0) / answers, 12) if answers else np.zeros(len(people))


def save_state(spark: SparkSession, path: str, generation: int, people: np.ndarray, best: np.ndarray, most: float, rng: np.random.Generator) -> None:
    """The population, the best individual and the generator's state as a table of one row."""
    row = (generation, people.tolist(), best.tolist(), float(most), json.dumps(rng.bit_generator.state))
    spark.createDataFrame([row], "generation int, people array<array<double>>, best array<double>, most double, state string").coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> tuple[int, np.ndarray, np.ndarray, float, np.random.Generator]:
    r = spark.read.parquet(path).first()
    rng = np.random.default_rng()
    rng.bit_generator.state = json.loads(r["state"])
    return r["generation"], np.array(r["people"], float), np.array(r["best"], float), r["most"], rng


def apply_best(rates: DataFrame, best: dict[str, float]) -> DataFrame:
    """(question_id, article_id, weight) of all rates by an individual's method weights; larger is better."""
    return score(rates, rates.sparkSession.createDataFrame(sorted(best.items()), "method string, w double"))


def evolve(
    spark: SparkSession,
    rates: DataFrame,
    train: DataFrame,
    validate: DataFrame,
    methods: Sequence[str],
    population: int = 100,
    generations: int = 20,
    tournament: int = 50,
    seed: int = 10,
    state: str | None = None,
) -> tuple[dict[str, float], float]:
    """The method weights with the best MRR on `validate` among the fittest of each generation on `train`, and that MRR.

    Normalised weights are made once, a row a question; a generation is a distributed job that reads them, with the
    population sent to every task, and exchanges nothing.  With a path `state` each
    generation's population and the generator's state are kept there, by generation, and a search that was broken off
    goes on after the last whole one, with the same result.
    """
    rng = np.random.default_rng(seed)
    people = rng.random((population, len(methods)))

    with scope(spark):
        table = store(by_question(rates, (train, validate), methods), "by-question")
        best, most, begin = people[0], -1.0, 0
        for g in range(generations, -1, -1) if state else ():
            if stored(spark, f"{state}/generation={g}"):
                begin, people, best, most, rng = load_state(spark, f"{state}/generation={g}")
                break
        for generation in range(begin, generations + 1):
            if state and generation > begin:
                save_state(spark, f"{state}/generation={generation}", generation, people, best, most, rng)
            fit = mean_ranks(spark, table, 0, 2, people)
            champion = people[int(fit.argmax())]
            checked = float(mean_ranks(spark, table, 1, 2, champion[None])[0])
            if checked > most:
                best, most = champion.copy(), checked
            if generation == generations:
                break
            chosen = rng.integers(0, population, (population, tournament))
            people = people[chosen[np.arange(population), fit[chosen].argmax(axis=1)]].copy()
            for i in range(0, population - 1, 2):
                if rng.random() < 0.5:
                    swap = rng.random(len(methods)) < 0.1
                    people[i, swap], people[i + 1, swap] = people[i + 1, swap].copy(), people[i, swap].copy()
            for i in range(population):
                if rng.random() < 0.25:
                    flip = rng.random(len(methods)) < 0.1
                    people[i, flip] = rng.integers(0, 2, int(flip.sum()))
    return dict(zip(methods, map(float, best), strict=True)), most
