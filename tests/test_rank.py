import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ensemble, evaluate, graph, ranking, tfidf, vectors

TEXTS = {1: "kot pies kot dom", 2: "pies dom las", 3: "las las rzeka", 4: "kot las"}


def corpus(spark, texts=TEXTS, question="kot pies"):
    rows = [(a, t.split()) for a, t in texts.items()]
    return spark.createDataFrame([(1, question.split())], "question_id long, words array<string>"), spark.createDataFrame(rows, "article_id long, words array<string>")


def scores(df):
    return {r["article_id"]: round(r["weight"], 6) for r in df.collect()}


@pytest.mark.parametrize(
    ("comparator", "want"),
    [
        ("tf-idf", {1: 5.545177, 2: 0.693147, 4: 0.693147}),
        ("cosine", {1: 0.051317, 2: 0.292893, 4: 0.292893}),
        ("euclidean", {1: 0.163376, 2: 0.490129, 4: 0.490129}),
        ("cityblock", {1: 0.231049, 2: 0.693147, 4: 0.693147}),
    ],
)
def test_document_scores(spark, comparator, want):
    assert scores(tfidf.score_documents(*corpus(spark), 4, comparator)) == want


def test_bigrams(spark):
    got = tfidf.score_bigrams(*corpus(spark), 4)
    assert scores(got) == {1: 11.090355}


def test_window_of_the_worked_case(spark):
    q, p = corpus(spark)
    best = tfidf.score_windows(q, p, 4, 1)
    assert scores(best)[1] == 11.090355
    words = {r["article_id"]: r["words"] for r in tfidf.window_words(best, q, p, 1).collect()}
    assert words[1] == "kot pies"


def brute_windows(texts, question, n, comparator):
    total = len(texts)
    df = {}
    for t in texts.values():
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(total / c) for w, c in df.items()}
    q = question.split()
    qw = {w: q.count(w) / len(q) * idf[w] for w in q if idf.get(w, 0) > 0}
    out = {}
    for a, t in texts.items():
        hits = [(i, w) for i, w in enumerate(t.split()) if w in q]
        made = []
        for i, _ in hits:
            inside = [w for j, w in hits if i - n <= j <= i]
            v = {w: inside.count(w) / n * idf[w] for w in inside}
            if comparator == "tf-idf":
                made.append(sum(v.values()) * len(v) ** 3)
                continue
            v = {w: v.get(w, 0.0) for w in qw}
            if comparator == "cosine":
                norm = math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in qw.values()))
                if norm:
                    made.append(1 - sum(v[w] * qw[w] for w in qw) / norm)
            elif comparator == "euclidean":
                made.append(math.sqrt(sum((v[w] - qw[w]) ** 2 for w in qw)))
            else:
                made.append(sum(abs(v[w] - qw[w]) for w in qw))
        if made:
            out[a] = (max if comparator == "tf-idf" else min)(made)
    return out


@pytest.mark.parametrize("comparator", ["tf-idf", "cosine", "euclidean", "cityblock"])
def test_windows_match_brute_force(spark, comparator):
    random.seed(1)
    texts = {a: " ".join(random.choices("abcdefgh", k=random.randint(3, 40))) for a in range(12)}
    texts[12] = "zz yy"
    got = scores(tfidf.score_windows(*corpus(spark, texts, "a b b e"), len(texts), 4, comparator))
    want = brute_windows(texts, "a b b e", 4, comparator)
    assert set(got) == set(want) and all(abs(got[a] - want[a]) < 1e-5 for a in want)


def test_windows_of_many_questions(spark):
    rng = random.Random(2)
    texts = {a: " ".join(rng.choices("abcdefgh", k=rng.randint(3, 40))) for a in range(12)}
    questions = {i: " ".join(rng.choices("abcdefghz", k=5)) for i in range(9)}
    _, articles = corpus(spark, texts)
    asked = spark.createDataFrame([(i, t.split()) for i, t in questions.items()], "question_id long, words array<string>")
    want = sorted((i, a, x) for i, t in questions.items() for a, x in brute_windows(texts, t, 4, "tf-idf").items())
    got = sorted((r["question_id"], r["article_id"], r["weight"]) for r in tfidf.score_windows(asked, articles, len(texts), 4).collect())
    assert [x[:2] for x in want] == [x[:2] for x in got] and all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(want, got, strict=True))
    best = {(i, a) for q in questions for i, a, _ in sorted((x for x in want if x[0] == q), key=lambda x: (-round(x[2], 6), x[1]))[:2]}
    assert best <= {(r["question_id"], r["article_id"]) for r in tfidf.score_windows(asked, articles, len(texts), 4, top=2).collect()}


def test_windows_in_small_steps(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    q = tfidf.Questions([(i, w, 1.0 + ord(w) / 100, None if w == "c" else 0.1) for i in range(5) for w in "abcd" if (i + ord(w)) % 3], {i: (0.5, 0.4) for i in range(5)})
    article = np.repeat(np.arange(6), 20)
    word, pos = rng.integers(0, 4, 120), np.tile(np.cumsum(rng.integers(1, 4, 20)), 6)
    run = lambda: sorted((int(a), int(b), int(c), round(float(d), 9)) for part in tfidf._windows(q, article, pos, word, 5, "cosine", 3.0, 0, 5) for a, b, c, d in zip(*part, strict=True))
    whole = run()
    for step in (1, 30, 200):
        monkeypatch.setattr(tfidf, "STEP_ROWS", step)
        assert run() == whole and len(whole) == 30


def test_ranks_solutions_and_rates(spark):
    q, p = corpus(spark)
    ranks = ranking.ranked(tfidf.score_documents(q, p, 4), False)
    assert {r["article_id"]: r["position"] for r in ranks.collect()} == {1: 1, 2: 2, 4: 3}
    gold = spark.createDataFrame([(1, 1), (1, 3)], "question_id long, article_id long")
    assert {r["article_id"]: (r["position"], round(r["weight"], 3)) for r in ranking.solutions(gold, ranks, False).collect()} == {1: (1, 5.545), 3: (100000, 0.0)}
    assert {r["article_id"]: r["weight"] for r in ranking.solutions(gold, ranks, True).collect()}[3] == 1e5
    assert {r["article_id"] for r in ranking.rates(gold, ranks, 2, False).collect()} == {1, 2, 3}


def test_pessimistic_ties(spark):
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate([0.5, 0.9, 0.5, 0.1])], "q long, i long, w double")
    assert [r["r"] for r in df.select("i", ranking.pessimistic_rank(F.col("w"), "q").alias("r")).orderBy("i").collect()] == [3, 1, 3, 4]


def test_metrics(spark):
    df = spark.createDataFrame([("m", p) for p in (1, 2, 50, 100000)], "method string, position long")
    r = evaluate.report(df, decimals=9).first()
    assert (r["p_1"], r["p_10"], r["p_100"], r["mrr"]) == (0.25, 0.5, 0.75, 0.3800025)
    none = df.limit(0).agg(evaluate.precision(F.col("position"), 1).alias("p"), evaluate.mean_reciprocal_rank(F.col("position")).alias("m")).first()
    assert (none["p"], none["m"]) == (0.0, 0.0)
    runs = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 2), (3, 1)], "question_id long, position long")
    assert evaluate.leading_run_p1(runs).first()["p1"] == 0.6


@pytest.mark.parametrize(("n", "shares", "want"), [(7, (60, 20, 20), [4, 1, 2]), (10, (60, 20, 20), [6, 2, 2]), (40, (60, 20, 20), [24, 8, 8]), (5, (50, 50), [2, 3])])
def test_split(spark, n, shares, want):
    parts = evaluate.split(spark.range(n).selectExpr("id * 1000 as id"), shares, "id").orderBy("id").collect()
    assert [r["part"] for r in parts] == [i for i, k in enumerate(want) for _ in range(k)]


def test_normalise(spark):
    df = spark.createDataFrame([(1, i, m, w) for m in ("cosine", "tfi") for i, w in enumerate([0.2, 0.4, None])], "question_id long, article_id long, method string, weight double")
    got = {(r["method"], r["article_id"]): r["x"] for r in ensemble.normalised(df).collect()}
    assert [got["cosine", i] for i in range(3)] == [0.5, 0, 0] and [got["tfi", i] for i in range(3)] == [0.5, 1, 0]


def test_evolution_prefers_the_telling_method(spark):
    rates, gold = [], []
    for q in range(6):
        gold.append((q, 3, "good", 1))
        rates += [(q, a, "good", 1.0 if a == 3 else 0.1 * a) for a in range(5)] + [(q, a, "bad", 1.0 - 0.2 * a) for a in range(5)]
    r = spark.createDataFrame(rates, "question_id long, article_id long, method string, weight double")
    s = spark.createDataFrame(gold, "question_id long, article_id long, method string, position int")
    best, mrr = ensemble.evolve(spark, r, s.where("question_id < 3"), s.where("question_id >= 3"), ["good", "bad"], population=8, generations=2, tournament=3)
    assert mrr == 1.0 and best["good"] > best["bad"]


def test_redirects(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (4, 4), (5, 6), (6, 5)], "article_id long, redirected_to long")
    articles = spark.createDataFrame([(i,) for i in range(1, 8)], "article_id long")
    got = {r["article_id"]: r["target"] for r in graph.resolve_redirects(edges, articles).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_evolution_query_has_its_full_size(spark, tmp_path, monkeypatch):
    from lodestone.plans import rank_queries

    spark.createDataFrame([(q, e, m, 1.0) for q in range(4) for e, m in enumerate("abcd")], "user_id long, event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    monkeypatch.setattr(ensemble, "evolve", lambda spark, rates, train, validate, methods, **more: seen.append((methods, {r["method"] for r in rates.collect()}, more)) or ({"a": 1.0}, 0.5))
    monkeypatch.setattr(rank_queries, "event_solutions", lambda *_: spark.range(2).withColumnRenamed("id", "question_id"))
    rank_queries.ea_search(spark, str(tmp_path))
    assert seen == [(list("abcd"), set("abcd"), {})]


def test_long_redirects(spark):
    edges = [(i, i - 1) for i in range(2, 301)] + [(1000 + i, 1000 + (i + 1) % 150) for i in range(150)]
    articles = spark.createDataFrame([(i,) for i in [*range(1, 301), *range(1000, 1150)]], "article_id long")
    got = {r["article_id"]: r["target"] for r in graph.resolve_redirects(spark.createDataFrame(edges, "article_id long, redirected_to long"), articles).collect()}
    assert got == {**{i: 1 for i in range(1, 301)}, **{i: 1000 for i in range(1000, 1150)}}


def test_dense_ids_keep_rows_without_source(spark, tmp_path):
    from lodestone.plans import rank_queries

    spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["rank"] for r in rank_queries.dense_ids(spark, str(tmp_path)).collect()} == {1: 2, 2: 3, 3: 1, 4: 2}


def test_nearest_in_groups(spark):
    random.seed(2)
    vecs = {f"w{i}": [random.gauss(0, 1) for _ in range(4)] for i in range(60)}
    table = spark.createDataFrame(list(vecs.items()), "id string, vec array<double>")
    queries = table.limit(7).withColumnRenamed("id", "query")
    cos = lambda a, b: 1 - sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for size in (1 << 20, 64):
        got = {}
        for r in vectors.nearest(queries, table.repartition(5), 3, query_bytes=size).collect():
            got.setdefault(r["query"], set()).add(r["id"])
        assert got == {q["query"]: set(sorted(vecs, key=lambda w, q=q: (round(cos(q["vec"], vecs[w]), 9), w))[:3]) for q in queries.collect()}


def test_vector_fallback(spark):
    vecs = spark.createDataFrame([("kot", [1.0, 0.0]), ("kocur", [0.0, 1.0])], "word string, vec array<double>")
    vocabulary = spark.createDataFrame([("kot",), ("koty",), ("inne",)], "word string")
    forms = spark.createDataFrame([("koty", "kot"), ("koty", "kocur"), ("inne", "brak")], "changed string, base string")
    assert {r["word"]: r["vec"] for r in vectors.with_fallback(vocabulary, vecs, forms).collect()} == {"kot": [1.0, 0.0], "kocur": [0.0, 1.0], "koty": [0.5, 0.5]}
    drawn = vectors.random_vectors(vocabulary, 3).collect()
    assert len(drawn) == 3 and drawn == vectors.random_vectors(vocabulary, 3).collect()


def test_common_words(spark):
    random.seed(3)
    vecs = {w: [random.gauss(0, 1) for _ in range(3)] for w in "abcdef"}
    table = spark.createDataFrame(list(vecs.items()), "word string, vec array<double>")
    texts = {i: random.choices("abcdefxyz", k=6) for i in range(40)}
    articles = spark.createDataFrame(list(texts.items()), "article_id long, words array<string>").repartition(3)
    asked = {1: ["a", "b", "b"], 2: ["c", "x", "d"], 3: ["z"], 4: ["f"]}
    words = spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "question_id long, word string")
    mean = lambda ws: [sum(x) / len(ws) for x in zip(*(vecs[w] for w in ws), strict=True)]
    cos = lambda a, b: 1 - sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for size in (1 << 20, 40):
        got = {}
        for r in vectors.rank_common_words(words, articles, table, 3, query_bytes=size).collect():
            got.setdefault(r["question_id"], []).append((round(r["weight"], 6), r["article_id"]))
        for q, ws in asked.items():
            own = [w for w in ws if w in vecs]
            shared = {a: [w for w in set(t) if w in own] for a, t in texts.items()}
            want = sorted((round(cos(mean(own), mean(s)), 6), a) for a, s in shared.items() if s)[:3]
            assert sorted(got.get(q, [])) == [(abs(d), a) if not d else (d, a) for d, a in want]
