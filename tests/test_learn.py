import math

import numpy as np
import pyarrow as pa

from lodestone.operators import learn


def plain_forward(numbers, matrix, w):
    """One pair's weight, loop by loop."""
    features = []
    for text in numbers:
        h = [[max(0.0, sum(matrix[i][d] * w["k1"][d][c] for d in range(len(matrix[0]))) + w["bk1"][c]) for c in range(learn.FIRST)] for i in text]
        for n in learn.RUNS:
            for f in range(learn.FILTERS):
                features.append(max(max(0.0, sum(h[p + i][c] * w[f"k{n}"][i][c][f] for i in range(n) for c in range(learn.FIRST)) + w[f"bk{n}"][f]) for p in range(len(text) - n + 1)))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    hidden = [sigmoid(sum(x * w["h1"][i][j] for i, x in enumerate(features)) + w["bh1"][j]) for j in range(learn.HIDDEN)]
    return sigmoid(sum(x * w["h2"][j][0] for j, x in enumerate(hidden)) + w["bh2"][0])


def example(seed=1, rows=6):
    rng = np.random.default_rng(seed)
    matrix = np.concatenate([np.zeros((1, 5)), rng.normal(0, 1, (9, 5))])
    parts = [rng.integers(0, 10, (rows, n)) for n in (6, 5, 8)]
    w = learn.new_weights(5, 3)
    for k in w:
        w[k] = w[k] + rng.normal(0, 0.1, w[k].shape)
    return parts, rng.integers(0, 2, rows).astype(float), matrix, w


def test_forward_matches_plain_loops():
    parts, _, matrix, w = example()
    got = learn.forward(parts, matrix, w)
    assert all(abs(got[r] - plain_forward([p[r].tolist() for p in parts], matrix, w)) < 1e-9 for r in range(6))


def test_gradient_matches_differences():
    parts, target, matrix, w = example(2)
    _, g = learn.gradient(parts, target, matrix, w)
    rng = np.random.default_rng(4)
    for k in w:
        for _ in range(6):
            at = tuple(int(rng.integers(0, n)) for n in w[k].shape)
            sides = []
            for step in (1e-6, -1e-6):
                moved = {x: v.copy() for x, v in w.items()}
                moved[k][at] += step
                sides.append(learn.gradient(parts, target, matrix, moved)[0])
            assert abs((sides[0] - sides[1]) / 2e-6 - g[k][at]) < 1e-6, (k, at)


def test_training_learns_and_keeps_the_best(spark, tmp_path):
    rng = np.random.default_rng(5)
    matrix = np.concatenate([np.zeros((1, 8)), rng.normal(0, 1, (20, 8))])

    def made(n):
        parts = [rng.integers(1, 20, (n, k)) for k in (6, 5, 8)]
        target = rng.integers(0, 2, n).astype(float)
        parts[2][target == 1, 2:4] = [7, 11]
        parts[2][target == 0] = np.where(parts[2][target == 0] == 7, 1, parts[2][target == 0])
        return parts, target

    train, validate = made(2000), made(300)
    w, history = learn.fit_convolution(train, validate, matrix, epochs=20)
    assert history[-1][0] < history[0][0] and max(a for _, a in history) > 0.85
    assert np.mean((learn.forward(validate[0], matrix, w) > 0.5) == validate[1]) == max(a for _, a in history)
    learn.save_weights(spark, w, str(tmp_path / "w"))
    back = learn.load_weights(spark, str(tmp_path / "w"))
    assert set(back) == set(w) and all((back[k] == w[k]).all() for k in w)


def words_of(spark):
    rng = np.random.default_rng(6)
    return learn.Words(spark.createDataFrame([(w, rng.normal(0, 1, 4).tolist()) for w in "abcdefgh"], "word string, vec array<double>"))


def tables(spark):
    rng = np.random.default_rng(7)
    text = lambda n: [str(x) for x in rng.choice(list("abcdefghz"), n)]
    questions = spark.createDataFrame([(i, text(5)) for i in range(7)] + [(7, [])], "question_id long, words array<string>")
    articles = spark.createDataFrame([(i, text(3), text(130)) for i in range(40)] + [(40, [], text(1))], "article_id long, title array<string>, content array<string>")
    return questions, articles


def test_numbers_of_words(spark):
    words = words_of(spark)
    assert words.numbers(pa.array([["a", "z", "c"], [], ["h"] * 9]), 4).tolist() == [[1, 0, 3, 0], [0] * 4, [8] * 4]


def test_scores_of_all_articles_by_the_network(spark):
    words, (questions, articles) = words_of(spark), tables(spark)
    w = learn.new_weights(4, 9)
    lists = lambda rows, i: pa.array([r[i] for r in rows], pa.list_(pa.string()))
    qs, xs = questions.orderBy("question_id").collect(), articles.orderBy("article_id").collect()
    q = words.numbers(lists(qs, 1), learn.WIDTHS[0])
    t, c = words.numbers(lists(xs, 1), learn.WIDTHS[1]), words.numbers(lists(xs, 2), learn.WIDTHS[2])
    got = {(r["question_id"], r["article_id"]): r["weight"] for r in learn.score_convolution(questions, articles, words, w, 3).collect()}
    want = {}
    for i in range(len(qs)):
        y = learn.forward([np.repeat(q[i : i + 1], len(xs), 0), t, c], words.matrix, w)
        for a in sorted(range(len(xs)), key=lambda a: (-round(y[a], 6), a))[:3]:
            want[i, a] = y[a]
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_scores_of_the_averaging_network(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    words, (questions, articles) = words_of(spark), tables(spark)
    q, a = learn.averaged(questions, "question_id", words, ["words"]), learn.averaged(articles, "article_id", words, ["title", "content"])
    pairs = spark.createDataFrame([(i % 8, i, i % 2) for i in range(40)], "question_id long, article_id long, target int")
    model = learn.fit_averaging(pairs, q, a, 4, epochs=20)
    rows = q.withColumnRenamed("features", "q").crossJoin(a.withColumnRenamed("features", "a")).select("question_id", "article_id", array_to_vector(F.concat("q", "a")).alias("features"))
    by = {}
    for r in model.transform(rows).select("question_id", "article_id", vector_to_array("probability")[1].alias("p")).collect():
        by.setdefault(r["question_id"], []).append((-round(r["p"], 6), r["article_id"], r["p"]))
    got = {(r["question_id"], r["article_id"]): r["weight"] for r in learn.score_averaging(model, q, a, 4, 2).collect()}
    want = {(i, x[1]): x[2] for i, xs in by.items() for x in sorted(xs)[:2]}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
