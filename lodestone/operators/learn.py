"""Learned rankers: training pairs, a convolutional two-tower network and a deep-averaging perceptron.

Networks are trained on at most TRAIN_ROWS pairs (the least hashes of their ids), as numbers of words; everything else,
articles' towers and the scoring of every question against every article, runs over whole tables in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import Best, _placed, _placed_numbers, _step, _word_numbers

#: Pairs that a network learns from at most, and bytes of word vectors that are sent to every task at most.
TRAIN_ROWS, TABLE_BYTES = 100_000, 256 << 20
#: Questions that are sent to every task together, about.
QUESTIONS = 10_000
#: Words that are taken from the beginning of a question, a title and a content.
WIDTHS = (20, 20, 100)
#: Sizes of the convolutional network: filters of one word, filters of runs, lengths of runs, hidden units of the head.
FIRST, FILTERS, RUNS, HIDDEN = 4, 32, (2, 3), 10
BATCH, RATE, LOSS_WEIGHT = 256, 1e-3, 0.2


def hard_negatives(ranks: DataFrame, answers: DataFrame, skip: int = 5, ratio: int = 1) -> DataFrame:
    """(question_id, article_id): best-ranked articles that are no answers, after the first `skip`; `ratio` an answer."""
    others = ranks.join(answers, ["question_id", "article_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("position", "article_id"))
    wanted = answers.groupBy("question_id").agg(F.count("*").alias("n_gold"))
    placed = others.withColumn("place", place).join(wanted, "question_id")
    return placed.where((F.col("place") > skip) & (F.col("place") <= skip + ratio * F.col("n_gold"))).select("question_id", "article_id")


def random_negatives(articles: DataFrame, answers: DataFrame, ratio: int = 1, seed: int = 10) -> DataFrame:
    """(question_id, article_id): `ratio` articles an answer, no answers; their places in the order of articles are drawn
    by the first 15 hex digits of the md5 of 'question:answer:number:seed'.
    """
    from .evaluate import with_place

    total = articles.count()
    placed = with_place(articles.select("article_id"), "article_id").select(F.col("__place").alias("place"), "article_id")
    draws = answers.select("question_id", F.explode(F.sequence(F.lit(1), F.lit(ratio))).alias("i"), F.col("article_id").alias("gold"))
    digest = F.md5(F.concat_ws(":", "question_id", "gold", "i", F.lit(seed)))
    drawn = draws.select("question_id", (F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long") % F.lit(max(1, total))).alias("place"))
    found = drawn.join(placed, "place").select("question_id", "article_id").distinct()
    return found.join(answers, ["question_id", "article_id"], "left_anti")


def permuted(rows: DataFrame, key: str, seed: int = 10) -> DataFrame:
    """rows in an order that the key's hash and the seed give."""
    return rows.orderBy(F.md5(F.concat_ws(":", key, F.lit(seed))), key)


def training_pairs(answers: DataFrame, negatives: DataFrame) -> DataFrame:
    """(question_id, article_id, target)."""
    return answers.select("question_id", "article_id", F.lit(1).alias("target")).unionByName(negatives.select("question_id", "article_id", F.lit(0).alias("target")))


class Words:
    """Word vectors as a matrix; row 0 is zeros and stands for padding and for words without a vector."""

    def __init__(self, vectors: DataFrame) -> None:
        rows, width = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
        if rows * (width or 1) * 8 > TABLE_BYTES:
            raise ValueError(f"word vectors take over {TABLE_BYTES} bytes")
        table = sorted((r["word"], r["vec"]) for r in vectors.select("word", "vec").collect())
        self.known = pa.array([w for w, _ in table], pa.string())
        self.matrix = np.concatenate([np.zeros((1, width or 1)), np.array([v for _, v in table], float).reshape(len(table), width or 1)])

    def numbers(self, lists: pa.ListArray, width: int) -> np.ndarray:
        """(rows, width) numbers of the first words of lists."""
        out = np.zeros((len(lists), width), np.int64)
        row, word, place = _placed_numbers(lists, self.known)
        early = place < width
        out[row[early], place[early]] = word[early] + 1
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


Weights = dict[str, np.ndarray]


def new_weights(size: int, seed: int = 10) -> Weights:
    """Uniform weights by the number of inputs and outputs of each layer."""
    rng = np.random.default_rng(seed)
    shapes = {"k1": (size, FIRST), **{f"k{n}": (n, FIRST, FILTERS) for n in RUNS}, "h1": (3 * FILTERS * len(RUNS), HIDDEN), "h2": (HIDDEN, 1)}
    out: Weights = {}
    for name, shape in shapes.items():
        limit = np.sqrt(6 / (np.prod(shape[:-1]) + (shape[-1] if len(shape) < 3 else shape[0] * shape[-1])))
        out[name] = rng.uniform(-limit, limit, shape)
        out["b" + name] = np.zeros(shape[-1])
    return out


def tower(numbers: np.ndarray, matrix: np.ndarray, w: Weights, trace: list | None = None) -> np.ndarray:
    """(rows, FILTERS * len(RUNS)) features of texts as padded word numbers: each run filter's greatest value."""
    first = np.maximum(matrix @ w["k1"] + w["bk1"], 0)  # one row a word, however often it stands
    h = first[numbers]
    out = []
    for n in RUNS:
        length = numbers.shape[1] - n + 1
        flat = np.concatenate([h[:, i : i + length] for i in range(n)], axis=2)
        made = flat @ w[f"k{n}"].reshape(n * FIRST, FILTERS) + w[f"bk{n}"]
        at = made.argmax(axis=1)
        top = np.maximum(np.take_along_axis(made, at[:, None], axis=1)[:, 0], 0)
        out.append(top)
        if trace is not None:
            trace.append((n, flat, at, top))
    if trace is not None:
        trace.append((first, numbers))
    return np.concatenate(out, axis=1)


def _tower_gradient(trace: list, upstream: np.ndarray, w: Weights, matrix: np.ndarray, g: Weights) -> None:
    first, numbers = trace[-1]
    d_first = np.zeros_like(first)
    row = np.arange(len(numbers))
    for j, (n, flat, at, top) in enumerate(trace[:-1]):
        up = upstream[:, j * FILTERS : (j + 1) * FILTERS] * (top > 0)
        seen = flat[row[:, None], at]  # (rows, FILTERS, n * FIRST): the run that each filter took
        g[f"k{n}"] += np.einsum("bf,bfc->cf", up, seen).reshape(n, FIRST, FILTERS)
        g[f"bk{n}"] += up.sum(axis=0)
        back = up[:, :, None] * w[f"k{n}"].reshape(n * FIRST, FILTERS).T[None]
        for i in range(n):
            np.add.at(d_first, numbers[row[:, None], at + i], back[:, :, i * FIRST : (i + 1) * FIRST])
    d_first *= first > 0
    g["k1"] += matrix.T @ d_first
    g["bk1"] += d_first.sum(axis=0)


def forward(parts: list[np.ndarray], matrix: np.ndarray, w: Weights) -> np.ndarray:
    """Weights of pairs from their question's, title's and content's word numbers."""
    x = np.concatenate([tower(p, matrix, w) for p in parts], axis=1)
    return _sigmoid(_sigmoid(x @ w["h1"] + w["bh1"]) @ w["h2"] + w["bh2"])[:, 0]


def gradient(parts: list[np.ndarray], target: np.ndarray, matrix: np.ndarray, w: Weights) -> tuple[float, Weights]:
    """Mean cross entropy times LOSS_WEIGHT, and its gradient."""
    g = {k: np.zeros_like(v) for k, v in w.items()}
    traces: list[list] = [[] for _ in parts]
    x = np.concatenate([tower(p, matrix, w, t) for p, t in zip(parts, traces, strict=True)], axis=1)
    h = _sigmoid(x @ w["h1"] + w["bh1"])
    y = _sigmoid(h @ w["h2"] + w["bh2"])[:, 0]
    clipped = np.clip(y, 1e-7, 1 - 1e-7)
    loss = -LOSS_WEIGHT * float(np.mean(target * np.log(clipped) + (1 - target) * np.log(1 - clipped)))
    up = (LOSS_WEIGHT * (y - target) / len(target))[:, None]
    g["h2"], g["bh2"] = h.T @ up, up.sum(axis=0)
    up = up @ w["h2"].T * h * (1 - h)
    g["h1"], g["bh1"] = x.T @ up, up.sum(axis=0)
    up = up @ w["h1"].T
    size = FILTERS * len(RUNS)
    for i, t in enumerate(traces):
        _tower_gradient(t, up[:, i * size : (i + 1) * size], w, matrix, g)
    return loss, g


def fit_convolution(train: tuple[list[np.ndarray], np.ndarray], validate: tuple[list[np.ndarray], np.ndarray], matrix: np.ndarray, epochs: int = 50, seed: int = 10) -> tuple[Weights, list[tuple[float, float]]]:
    """The weights after the epoch with the best accuracy on `validate` (the first of equals), and each epoch's loss and
    that accuracy.  Mini-batches of BATCH, RMSprop.
    """
    rng, w = np.random.default_rng(seed), new_weights(matrix.shape[1], seed)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    best, most, history = {k: v.copy() for k, v in w.items()}, -1.0, []
    parts, target = train
    for _ in range(epochs):
        order, losses = rng.permutation(len(target)), []
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            loss, g = gradient([p[some] for p in parts], target[some], matrix, w)
            losses.append(loss * len(some))
            for k in w:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k] ** 2
                w[k] = w[k] - RATE * g[k] / (np.sqrt(mean[k]) + 1e-7)
        hit = float(np.mean((forward(validate[0], matrix, w) > 0.5) == validate[1])) if len(validate[1]) else 0.0
        history.append((sum(losses) / max(1, len(target)), hit))
        if hit > most:
            best, most = {k: v.copy() for k, v in w.items()}, hit
    return best, history


def save_weights(spark: SparkSession, weights: Weights, path: str) -> None:
    """A table (name, shape, cells): a network that can be read back."""
    rows = [(k, list(v.shape), [float(x) for x in v.ravel()]) for k, v in sorted(weights.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, cells array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> Weights:
    return {r["name"]: np.array(r["cells"], float).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def pair_texts(pairs: DataFrame, questions: DataFrame, articles: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(question, title, content, target): first words of at most `most` pairs, in an order that their ids give.

    questions: (question_id, words).  articles: (article_id, title, content).
    """
    drawn = pairs.orderBy(F.xxhash64("question_id", "article_id"), "question_id", "article_id").limit(most)
    some = lambda c, n: F.slice(c, 1, n)
    rows = drawn.join(questions.select("question_id", some("words", WIDTHS[0]).alias("question")), "question_id")
    rows = rows.join(articles.select("article_id", some("title", WIDTHS[1]).alias("title"), some("content", WIDTHS[2]).alias("content")), "article_id")
    return rows.orderBy(F.xxhash64("question_id", "article_id"), "question_id", "article_id").select("question", "title", "content", "target")


def numbered(texts: DataFrame, words: Words) -> tuple[list[np.ndarray], np.ndarray]:
    """Word numbers of question, title and content, and targets, of the rows of pair_texts."""
    rows = texts.collect()
    lists = lambda i: pa.array([r[i] for r in rows], pa.list_(pa.string()))
    return [words.numbers(lists(i), n) for i, n in enumerate(WIDTHS)], np.array([r["target"] for r in rows], float)


def article_features(articles: DataFrame, words: Words, w: Weights) -> DataFrame:
    """(article_id, features): title's and content's towers, once an article and not once a question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = np.concatenate([tower(words.numbers(part.column(i), n), words.matrix, w) for i, n in ((1, WIDTHS[1]), (2, WIDTHS[2]))], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["article_id", "features"])

    first = articles.select(F.col("article_id").cast("long").alias("article_id"), F.slice("title", 1, WIDTHS[1]).alias("title"), F.slice("content", 1, WIDTHS[2]).alias("content"))
    return first.mapInArrow(run, "article_id long, features array<double>")


def question_features(questions: DataFrame, words: Words, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Ids and tower features of a group of questions, on the driver."""
    rows = sorted((r["question_id"], r["words"]) for r in questions.select("question_id", F.slice("words", 1, WIDTHS[0]).alias("words")).collect())
    lists = pa.array([x for _, x in rows], pa.list_(pa.string()))
    return np.array([q for q, _ in rows], np.int64), tower(words.numbers(lists, WIDTHS[0]), words.matrix, w) if rows else np.zeros((0, FILTERS * len(RUNS)))


def score_all(ids: np.ndarray, features: np.ndarray, articles: DataFrame, hidden: np.ndarray, bias: np.ndarray, out: np.ndarray, out_bias: float, k: int) -> DataFrame:
    """(question_id, article_id, weight) of the k articles with the greatest weight for each question, over all articles.

    The head's hidden layer is a sum of what the question and what the article give it, so each is multiplied once; a
    task keeps k articles a question.  articles: (article_id, features).
    """
    of_question = features @ hidden[: features.shape[1]] + bias

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Best(len(ids), k, 6)
        step = _step(len(ids) * len(bias), len(bias))
        for batch in batches:
            for at in range(0, batch.num_rows if len(ids) else 0, step):
                part = batch.slice(at, step)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                of_article = flat @ hidden[features.shape[1] :]
                y = _sigmoid(_sigmoid(of_question[:, None, :] + of_article[None]) @ out + out_bias)
                held.add(-y, part.column(0).to_numpy(zero_copy_only=False))  # the greatest first
        q, a, d = held.rows(ids)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(a, pa.int64()), pa.array(d, pa.float64())], names=["question_id", "article_id", "weight"])

    found = articles.select("article_id", "features").mapInArrow(best, "question_id long, article_id long, weight double")
    return _placed(found, k, 6, "question_id", "article_id").select("question_id", "article_id", (-F.col("weight")).alias("weight"))


def _in_groups(questions: DataFrame, score) -> DataFrame:
    """The union of score(group) over groups of about QUESTIONS questions, one pass over the articles each."""
    groups = max(1, -(-questions.count() // QUESTIONS))
    out = None
    for g in range(groups):
        part = score(questions if groups == 1 else questions.where(F.pmod(F.xxhash64("question_id"), F.lit(groups)) == g))
        out = part if out is None else out.unionByName(part)
    return out


def score_convolution(questions: DataFrame, articles: DataFrame, words: Words, w: Weights, k: int) -> DataFrame:
    """The k best articles (article_id, title, content) of each question (question_id, words) by the network."""
    features = article_features(articles, words, w)
    score = lambda group: score_all(*question_features(group, words, w), features, w["h1"], w["bh1"], w["h2"][:, 0], float(w["bh2"][0]), k)
    return _in_groups(questions, score)


def averaged(rows: DataFrame, key: str, words: Words, columns: list[str]) -> DataFrame:
    """(key, features): for each column of words the mean of their vectors, zeros where no word has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = []
                for i in range(len(columns)):
                    row, word = _word_numbers(part.column(i + 1), words.known)
                    sums = np.zeros((part.num_rows, words.matrix.shape[1]))
                    for j in range(0, len(row), 1 << 16):
                        np.add.at(sums, row[j : j + (1 << 16)], words.matrix[word[j : j + (1 << 16)] + 1])
                    made.append(sums / np.maximum(np.bincount(row, minlength=part.num_rows), 1)[:, None])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(np.concatenate(made, axis=1)), pa.list_(pa.float64()))], names=[key, "features"])

    empty = F.array().cast("array<string>")
    return rows.select(F.col(key).cast("long").alias(key), *[F.coalesce(c, empty).alias(c) for c in columns]).mapInArrow(run, f"{key} long, features array<double>")


def fit_averaging(pairs: DataFrame, questions: DataFrame, articles: DataFrame, size: int, epochs: int = 200, seed: int = 10):
    """A perceptron over averaged words: 3 * size inputs, one hidden layer of `size`; pairs (question_id, article_id, target)."""
    rows = pairs.join(questions.withColumnRenamed("features", "q"), "question_id").join(articles.withColumnRenamed("features", "a"), "article_id")
    rows = rows.select(array_to_vector(F.concat("q", "a")).alias("features"), "target")
    return MultilayerPerceptronClassifier(layers=[3 * size, size, 2], maxIter=epochs, seed=seed, labelCol="target").fit(rows)


def score_averaging(model, questions: DataFrame, articles: DataFrame, size: int, k: int) -> DataFrame:
    """The k best articles of each question; both tables have averaged features."""
    cells = model.weights.toArray()
    # layer by layer: weights by output, then the outputs' biases
    n = 3 * size * size
    hidden, bias = cells[:n].reshape(size, 3 * size, order="F").T, cells[n : n + size]
    last = cells[n + size : n + size + 2 * size].reshape(2, size, order="F")
    last_bias = cells[n + size + 2 * size :]

    def score(group: DataFrame) -> DataFrame:
        rows = sorted((r["question_id"], r["features"]) for r in group.collect())
        ids, features = np.array([q for q, _ in rows], np.int64), np.array([f for _, f in rows], float).reshape(len(rows), size)
        # the softmax of two outputs is the sigmoid of their difference
        return score_all(ids, features, articles, hidden, bias, last[1] - last[0], float(last_bias[1] - last_bias[0]), k)

    return _in_groups(questions, score)
