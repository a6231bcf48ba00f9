"""The grid of methods: every combination of a field, n-grams, windows, least rarities and comparators, by parameters.

    python -m lodestone.plans.resolve SF_DIR OUT [--title] [--ngram 1|2] [--neighbors 0,15,250] [--min-idf 0.0,1.6]
        [--power 3] [--comparators tf-idf,cosine] [--top 10] [--questions N]

ranks the questions of SF_DIR by each method, and keeps solutions and rates in OUT; methods that have solved all
questions already are left out.
"""

from __future__ import annotations

import argparse
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking, tfidf
from ..sources import sinks
from ..storage import exists, scope, store


@dataclass(frozen=True)
class Grid:
    title: bool = False
    ngram: int = 1
    neighbors: Sequence[int] = (0,)
    min_idf: Sequence[float] = (0.0,)
    power: Sequence[float] = (3.0,)
    comparators: Sequence[str] = ("tf-idf",)
    prefix: str = ""

    def methods(self) -> Iterator[tuple[str, int, float, str, float]]:
        """(name, window, least rarity, comparator, power); only tf-idf has a power, only it several of them."""
        for n in self.neighbors:
            for least in self.min_idf:
                for comparator in self.comparators:
                    for power in self.power if comparator == "tf-idf" else self.power[:1]:
                        tail = f", pf: {power:.2f}" if comparator == "tf-idf" else f", m: {comparator}"
                        yield f"{self.prefix}, type: tfi, title: {int(self.title)}, ngram: {self.ngram}, mwiw: {least:.2f}, n: {n:03d}{tail}", n, least, comparator, power


def scores(questions: DataFrame, articles: DataFrame, n_articles: int, grid: Grid, n: int, least: float, comparator: str, power: float, frequencies: DataFrame | None = None) -> DataFrame:
    if n and grid.ngram == 1:
        return tfidf.score_windows(questions, articles, n_articles, n, comparator, power, least, frequencies).select("question_id", "article_id", "weight")
    if n:
        raise ValueError("windows are of single words")
    if grid.ngram == 2:
        return tfidf.score_bigrams(questions, articles, n_articles, comparator, power, least)
    return tfidf.score_documents(questions, articles, n_articles, comparator, power, least, frequencies)


def resolve(spark: SparkSession, questions: DataFrame, articles: DataFrame, n_articles: int, answers: DataFrame, grid: Grid, out: str, top: int = 10, frequencies: DataFrame | None = None) -> list[str]:
    """Rank questions by the grid's methods into out; the names of those that were left to do."""
    done = []
    wanted = answers.select("question_id", "article_id").distinct()
    for name, n, least, comparator, power in grid.methods():
        if exists(spark, f"{out}/solutions"):
            have = spark.read.parquet(f"{out}/solutions").where(F.col("method") == name)
            if wanted.join(have, ["question_id", "article_id"], "left_anti").isEmpty():
                continue
        with scope(spark):
            smaller = tfidf.SMALLER_FIRST[comparator]
            all_scores = store(scores(questions, articles, n_articles, grid, n, least, comparator, power, frequencies), "scores")
            gold = ranking.gold_ranks(wanted, all_scores, smaller)
            best = gold.unionByName(ranking.top(all_scores, top, smaller)).distinct()
            sinks.save_ranking(ranking.solutions(wanted, gold, smaller), ranking.rates(wanted, best, top, smaller), name, out)
        done.append(name)
    return done


def main() -> None:
    from .rank_queries import Corpus, gold_answers

    parser = argparse.ArgumentParser(prog="lodestone.plans.resolve")
    numbers = lambda kind: lambda x: tuple(kind(v) for v in x.split(","))
    parser.add_argument("sf_dir")
    parser.add_argument("out")
    parser.add_argument("--title", action="store_true", help="titles, not contents")
    parser.add_argument("--ngram", type=int, default=1, choices=[1, 2])
    parser.add_argument("--neighbors", type=numbers(int), default=(0,), help="windows; 0 is the whole document")
    parser.add_argument("--min-idf", type=numbers(float), default=(0.0,), help="only words rarer than this")
    parser.add_argument("--power", type=numbers(float), default=(3.0,), help="powers of the number of matched words")
    parser.add_argument("--comparators", type=numbers(str), default=("tf-idf", "cosine"))
    parser.add_argument("--prefix", default="", help="makes names of methods unique")
    parser.add_argument("--top", type=int, default=10)
    parser.add_argument("--questions", type=int, default=0, help="the first n questions; 0 for all")
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    corpus = Corpus(spark, args.sf_dir, args.title)
    questions = corpus.questions.orderBy("question_id").limit(args.questions) if args.questions else corpus.questions
    answers = gold_answers(spark, args.sf_dir).join(questions, "question_id", "left_semi")
    grid = Grid(args.title, args.ngram, args.neighbors, args.min_idf, args.power, args.comparators, args.prefix)
    for name in resolve(spark, questions, corpus.articles, corpus.n, answers, grid, args.out, args.top, corpus.frequencies):
        print(name)


if __name__ == "__main__":
    main()
