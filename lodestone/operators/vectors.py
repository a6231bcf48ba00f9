"""Word vectors: means, cosine distances, nearest words and fallbacks.

A vector is an array<double>; a word without one has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that are sent to every task at most; more are compared group by group.
BROADCAST_BYTES = 64 << 20
#: Cells of a matrix that a task computes at once.
STEP_CELLS = 8 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def width_of(vectors: DataFrame, vec: str = "vec") -> int:
    return vectors.agg(F.max(F.size(vec))).first()[0] or 1


def mean_vectors(rows: DataFrame, key: str | list[str], width: int, vec: str = "vec") -> DataFrame:
    """(key..., vec): means by dimension, over rows that have a vector of `width` numbers.

    Dimensions are summed as columns, in the tasks first, so one row a key and task is exchanged whatever a key's size.
    """
    keys = [key] if isinstance(key, str) else key
    sums = rows.where(F.col(vec).isNotNull()).groupBy(*keys).agg(*[F.avg(F.get(vec, F.lit(i))).alias(f"__{i}") for i in range(width)])
    return sums.select(*keys, F.array(*[f"__{i}" for i in range(width)]).alias("vec"))


def question_vectors(question_words: DataFrame, vectors: DataFrame) -> DataFrame:
    """(question_id, qvec): mean of the words' vectors; a question none of whose words has one gets no row."""
    return mean_vectors(question_words.join(vectors, "word"), "question_id", width_of(vectors)).withColumnRenamed("vec", "qvec")


class Best:
    """The k nearest rows of each query so far, by distance (rounded) and then by id; never more than k of each."""

    def __init__(self, queries: int, k: int, decimals: int) -> None:
        self.k, self.decimals = k, decimals
        self.distance, self.raw = np.full((queries, 0), np.inf), np.full((queries, 0), np.inf)
        self.ids: np.ndarray | None = None

    def add(self, distance: np.ndarray, ids: np.ndarray) -> None:
        """distance (queries, rows), NaN where there is none; ids of the rows, not masked."""
        by_id = np.argsort(ids, kind="stable")
        raw = np.where(np.isnan(distance), np.inf, distance)[:, by_id]
        near = np.round(raw, self.decimals)
        first = np.argsort(near, axis=1, kind="stable")[:, : self.k]  # equal distances stay in the order of ids
        near, raw, ids = (np.take_along_axis(x, first, axis=1) for x in (near, raw, np.broadcast_to(ids[by_id], near.shape)))
        if self.ids is not None:
            near, raw, ids = (np.concatenate(x, axis=1) for x in ((self.distance, near), (self.raw, raw), (self.ids, ids)))
            order = np.lexsort((ids, near), axis=1)[:, : self.k]
            near, raw, ids = (np.take_along_axis(x, order, axis=1) for x in (near, raw, ids))
        self.distance, self.raw, self.ids = near, raw, ids

    def rows(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) as columns."""
        if self.ids is None:
            return names[:0], names[:0], np.empty(0)
        of, at = np.nonzero(self.distance < np.inf)
        return names[of], self.ids[of, at], self.raw[of, at]


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row has no direction."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, np.nan, size)


def _step(queries: int, width: int) -> int:
    """Rows that a task compares with all queries at once."""
    return max(1, min(4096, STEP_CELLS // max(1, queries, width)))


def _placed(found: DataFrame, k: int, decimals: int, query: str, row: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.round("weight", decimals), row))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _placed_numbers(words: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the row, number of the word, place in the row) of all words of lists that are among the known ones."""
    sizes = np.diff(words.offsets.to_numpy())
    number = pc.index_in(words.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(number >= 0)
    row = np.repeat(np.arange(len(sizes)), sizes)[hit]
    return row, number[hit].astype(np.int64), hit - (np.cumsum(sizes) - sizes)[row]


def _word_numbers(words: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return _placed_numbers(words, known)[:2]


def rank_common_words(question_words: DataFrame, articles: DataFrame, vectors: DataFrame, k: int, expanded: DataFrame | None = None, query_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(question_id, article_id, weight) of the k best: cosine distance of the question's mean to the mean of the
    distinct words that the article (article_id, words) shares with the question, or with its expansion.

    A stated query set against all rows, in blocks: a task gets a bounded group of questions, as the vectors of their words
    and a table of which question has which, sums those that articles have as products of matrices, and gives on its k
    best of each question.
    """
    wanted = (question_words if expanded is None else expanded).distinct().join(vectors, "word")
    means = question_vectors(question_words, vectors)
    width = width_of(vectors)
    n_pairs, n_words, n_questions = wanted.agg(F.count("*"), F.count_distinct("word"), F.count_distinct("question_id")).first()
    # a group has at most all words, and a row of the table for each of its questions
    groups = max(1, -(-(n_pairs * 8 + n_questions * (n_words * 4 + width * 8)) // query_bytes))
    out = None
    for g in range(groups):
        mine = F.pmod(F.xxhash64("question_id"), F.lit(groups)) == g
        questions = {r["question_id"]: r["qvec"] for r in means.where(mine).collect()}
        ids = np.array(sorted(questions), np.int64)
        pairs = [(r["question_id"], r["word"]) for r in wanted.where(mine).select("question_id", "word").collect() if r["question_id"] in questions]
        table = {r["word"]: r["vec"] for r in wanted.where(mine).select("word", "vec").dropDuplicates(["word"]).collect()}
        number = {w: i for i, w in enumerate(sorted(table))}
        has = np.zeros((len(ids), len(number)), np.float32)
        if pairs:
            has[np.searchsorted(ids, [q for q, _ in pairs]), [number[w] for _, w in pairs]] = 1
        matrix = np.array([table[w] for w in number], float).reshape(len(number), width)
        unit = _unit(np.array([questions[q] for q in ids.tolist()], float).reshape(len(ids), width))
        known = pa.array(list(number), pa.string())

        def best(batches: Iterator[pa.RecordBatch], known=known, has=has, matrix=matrix, unit=unit, ids=ids) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            held = Best(len(ids), k, 6)
            step = _step(len(ids), max(matrix.shape))
            # the product of a question's mean and of each word, and of words with each other, by question
            along = has * (unit @ matrix.T).astype(float)
            for batch in batches:
                for at in range(0, batch.num_rows if len(ids) else 0, step):
                    part = batch.slice(at, step)
                    row, word = _word_numbers(part.column(1), known)
                    there = np.zeros((part.num_rows, len(known)))
                    there[row, word] = 1
                    dots = along @ there.T
                    size = np.empty_like(dots)
                    for q in range(len(ids)):
                        own = np.flatnonzero(has[q])
                        size[q] = np.linalg.norm(there[:, own] @ matrix[own], axis=1)
                    size[size == 0] = np.nan
                    held.add(1 - dots / size, part.column(0).to_numpy(zero_copy_only=False))
            q, a, d = held.rows(ids)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(a, pa.int64()), pa.array(d, pa.float64())], names=["question_id", "article_id", "weight"])

        found = articles.select(F.col("article_id").cast("long").alias("article_id"), "words").mapInArrow(best, "question_id long, article_id long, weight double")
        out = found if out is None else out.unionByName(found)
    return _placed(out, k, 6, "question_id", "article_id")


def score_all_words(question_words: DataFrame, articles: DataFrame, vectors: DataFrame, k: int, table_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(question_id, article_id, weight) of the k articles nearest to each question; all words count as often as they stand.

    articles: (article_id, words).  Where the vectors are under table_bytes, an article's mean is made in its own task;
    else its words are counted and meet the vectors by a join.
    """
    queries = question_vectors(question_words, vectors).select(F.col("question_id").alias("query"), F.col("qvec").alias("vec"))
    rows, width = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    if rows * (width or 1) * 8 <= table_bytes:
        table = sorted((r["word"], r["vec"]) for r in vectors.select("word", "vec").collect())
        matrix, known = np.array([v for _, v in table], float).reshape(len(table), width or 1), pa.array([w for w, _ in table], pa.string())

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    row, word = _word_numbers(part.column(1), known)
                    pairs, n = np.unique(row * np.int64(len(known) + 1) + word, return_counts=True)  # a product for each distinct word
                    of, which = pairs // (len(known) + 1), pairs % (len(known) + 1)
                    sums, total = np.zeros((part.num_rows, matrix.shape[1])), np.bincount(of, n, part.num_rows)
                    for i in range(0, len(pairs), 1 << 16):
                        np.add.at(sums, of[i : i + (1 << 16)], matrix[which[i : i + (1 << 16)]] * n[i : i + (1 << 16), None])
                    have = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(have)), pa.array(list(sums[have] / total[have, None]), pa.list_(pa.float64()))], names=["id", "vec"])

        means = articles.select(F.col("article_id").cast("long").alias("id"), "words").mapInArrow(mean, "id long, vec array<double>")
    else:
        counts = articles.select("article_id", F.explode("words").alias("word")).groupBy("article_id", "word").agg(F.count("*").alias("n")).join(vectors, "word")
        sums = counts.groupBy("article_id").agg(F.sum("n").alias("n"), *[F.sum(F.get("vec", F.lit(i)) * F.col("n")).alias(f"__{i}") for i in range(width)])
        means = sums.select(F.col("article_id").alias("id"), F.array(*[F.col(f"__{i}") / F.col("n") for i in range(width)]).alias("vec"))
    found = nearest(queries, means, k)
    return found.select(F.col("query").alias("question_id"), F.col("id").alias("article_id"), "weight")


def nearest(queries: DataFrame, rows: DataFrame, k: int, query_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query, id, weight): the k rows (id, vec) nearest to each query (query, vec) by cosine distance, ties by id.

    A stated query set against all rows, in blocks: queries come in groups of bounded bytes, one after the other; each
    task keeps its k best of each query, ties or not, so what is held and exchanged is k rows a query and task.
    """
    kind, qkind = dict(rows.dtypes)["id"], dict(queries.dtypes)["query"]
    width, n = queries.agg(F.max(F.size("vec")), F.count("*")).first()
    groups = max(1, -(-(width or 0) * n * 8 // query_bytes))
    typed = lambda t: pa.string() if t == "string" else pa.int64()
    out = None
    for g in range(groups):
        part = queries if groups == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(groups)) == g)
        taken = sorted((r["query"], r["vec"]) for r in part.select("query", "vec").collect())
        if not taken and groups > 1:
            continue
        names = np.array([q for q, _ in taken])
        matrix = _unit(np.array([v for _, v in taken], float).reshape(len(taken), width or 1))

        def best(batches: Iterator[pa.RecordBatch], matrix: np.ndarray = matrix, names: np.ndarray = names) -> Iterator[pa.RecordBatch]:
            held = Best(len(names), k, 9)
            step = _step(len(names), matrix.shape[1])
            for batch in batches:
                for at in range(0, batch.num_rows if len(names) else 0, step):
                    rows = batch.slice(at, step)
                    flat = rows.column(1).flatten().to_numpy(zero_copy_only=False)
                    held.add(1 - matrix @ _unit(flat.reshape(rows.num_rows, -1)).T, np.array(rows.column(0).to_pylist()))
            q, i, d = held.rows(names)
            yield pa.RecordBatch.from_arrays([pa.array(q.tolist(), typed(qkind)), pa.array(i.tolist(), typed(kind)), pa.array(np.round(d, 9), pa.float64())], names=["query", "id", "weight"])

        found = rows.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(best, f"query {qkind}, id {kind}, weight double")
        out = found if out is None else out.unionByName(found)
    return _placed(out, k, 9, "query", "id")


def similar_words(words: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(word, similar): the k words nearest to each given word that has a vector, besides itself; and the words themselves."""
    given = words.select("word").distinct()
    queries = given.join(vectors, "word").select(F.col("word").alias("query"), "vec")
    near = nearest(queries, vectors.select(F.col("word").alias("id"), "vec"), k + 1).where("query <> id")
    place = F.row_number().over(Window.partitionBy("query").orderBy("weight", "id"))
    kept = near.withColumn("place", place).where(F.col("place") <= k).select(F.col("query").alias("word"), F.col("id").alias("similar"))
    return kept.union(given.select("word", F.col("word").alias("similar"))).distinct()


def with_fallback(vocabulary: DataFrame, vectors: DataFrame, forms: DataFrame) -> DataFrame:
    """(word, vec): own vectors, and for words without one the mean of their base forms' own vectors; in a single pass."""
    lacking = vocabulary.select("word").distinct().join(vectors, "word", "left_anti")
    bases = lacking.join(forms, lacking["word"] == forms["changed"]).select("word", "base")
    found = bases.join(vectors.select(F.col("word").alias("base"), "vec"), "base")
    return vectors.select("word", "vec").unionByName(mean_vectors(found.select("word", "vec"), "word", width_of(vectors)))


def random_vectors(vocabulary: DataFrame, size: int, seed: int = 10) -> DataFrame:
    """(word, vec) drawn from a normal distribution; a word's vector depends on the word and the seed only."""
    uniform = lambda i, salt: (F.pmod(F.xxhash64("word", F.lit(seed), i, F.lit(salt)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = lambda i: F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * np.pi * uniform(i, 1))
    return vocabulary.select("word", F.transform(F.sequence(F.lit(1), F.lit(size)), normal).alias("vec"))
