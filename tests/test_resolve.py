import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.operators import ensemble, evaluate, graph, ranking, vectors
from lodestone.plans import resolve, views

TEXTS = {1: "kot pies kot dom", 2: "pies dom las", 3: "las las rzeka", 4: "kot las"}


def tables(spark):
    questions = spark.createDataFrame([(1, ["kot", "pies"]), (2, ["las"])], "question_id long, words array<string>")
    articles = spark.createDataFrame([(a, t.split()) for a, t in TEXTS.items()], "article_id long, words array<string>")
    return questions, articles, spark.createDataFrame([(1, 1), (1, 3), (2, 4)], "question_id long, article_id long")


def test_grid_and_what_is_solved_already(spark, tmp_path):
    questions, articles, answers = tables(spark)
    out = f"file://{tmp_path}/out"
    many = [m[0] for m in resolve.Grid(neighbors=(0, 1), power=(1.0, 3.0), comparators=("tf-idf", "cosine")).methods()]
    assert len(many) == len(set(many)) == 6
    grid = resolve.Grid(neighbors=(0, 1), power=(1.0,))
    names = [m[0] for m in grid.methods()]
    assert len(names) == 2 and names[0] == ", type: tfi, title: 0, ngram: 1, mwiw: 0.00, n: 000, pf: 1.00"
    assert resolve.resolve(spark, questions, articles, 4, answers, grid, out) == names
    assert resolve.resolve(spark, questions, articles, 4, answers, grid, out) == []
    solved = {(r["question_id"], r["article_id"]): r["position"] for r in spark.read.parquet(f"{out}/solutions").where(F.col("method") == names[0]).collect()}
    assert solved == {(1, 1): 1, (1, 3): ranking.MISSING, (2, 4): 3}  # equal weights go by id
    more = answers.union(spark.createDataFrame([(2, 2)], answers.schema))
    assert resolve.resolve(spark, questions, articles, 4, more, grid, out) == names


def test_gold_ranks_are_places_of_a_full_sort(spark):
    rng = np.random.default_rng(1)
    rows = [(q, a, float(rng.integers(0, 6)) / 7) for q in range(4) for a in range(30)]
    scores = spark.createDataFrame(rows, "question_id long, article_id long, weight double")
    answers = spark.createDataFrame([(q, a) for q in range(5) for a in (3, 17, 29, 40)], "question_id long, article_id long")
    for smaller in (True, False):
        full = ranking.ranked(scores, smaller).join(answers, ["question_id", "article_id"], "left_semi")
        want = sorted((r["question_id"], r["article_id"], r["position"]) for r in full.collect())
        assert sorted((r["question_id"], r["article_id"], r["position"]) for r in ranking.gold_ranks(answers, scores, smaller).collect()) == want


def test_places_whatever_the_values(spark):
    ids = [*range(500), 10**15, -(10**12)]
    placed = evaluate.with_place(spark.createDataFrame([(i,) for i in ids], "id long"), "id", bins=16)
    assert {r["id"]: r["__place"] for r in placed.collect()} == {i: n for n, i in enumerate(sorted(ids))}
    assert placed.select("__place").distinct().count() == len(ids)


def test_nearest_with_many_equal_vectors(spark):
    rows = spark.range(10_000, numPartitions=1).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vec")).union(spark.createDataFrame([(20_000, [0.0, 0.0]), (20_001, [1.0, 2.0])], "id long, vec array<double>"))
    queries = spark.createDataFrame([(7, [2.0, 4.0]), (8, [0.0, 0.0])], "query long, vec array<double>")
    got = sorted((r["query"], r["id"]) for r in vectors.nearest(queries, rows.coalesce(1), 3).collect())
    assert got == [(7, 0), (7, 1), (7, 2)]
    held = vectors.Best(2, 3, 9)
    for i in range(50):
        held.add(np.zeros((2, 100)), np.arange(100 * i, 100 * i + 100))
    assert held.distance.shape == (2, 3) and held.ids.tolist() == [[0, 1, 2]] * 2


def test_search_goes_on_after_a_break(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    rates = spark.createDataFrame([(q, a, m, float(rng.random())) for q in range(6) for a in range(8) for m in ("x", "y")], "question_id long, article_id long, method string, weight double").cache()
    solved = spark.createDataFrame([(q, q % 8, "x", 1) for q in range(6)], "question_id long, article_id long, method string, position long")
    run = lambda **more: ensemble.evolve(spark, rates, solved.where("question_id < 4"), solved.where("question_id >= 4"), ["x", "y"], population=6, generations=2, tournament=3, **more)
    whole, path = run(), f"file://{tmp_path}/state"
    keep, real = [], ensemble.save_state

    def broken(spark, path, generation, *rest):
        real(spark, path, generation, *rest)
        keep.append(generation)
        if generation == 1 and len(keep) == 1:
            raise RuntimeError("broken off")

    monkeypatch.setattr(ensemble, "save_state", broken)
    with pytest.raises(RuntimeError):
        run(state=path)
    assert run(state=path) == whole and keep == [1, 2]
    best = ensemble.apply_best(rates, whole[0])
    assert ranking.gold_ranks(solved, best, False).count() == 6


def test_report_and_cache(spark, tmp_path):
    report = spark.createDataFrame([("m2", 3, 0.5, 1.0, 1.0, 0.75), ("m1", 4, 0.25, 0.5, 1.0, 0.4)], "method string, answers long, p_1 double, p_10 double, p_100 double, mrr double")
    text = evaluate.text_report(report, spark.createDataFrame([("m1", True), ("m2", False)], "method string, is_smaller_first boolean"), "all").split("\n")
    assert text[1].startswith("< m1") and text[1].endswith("4  0.2500  0.5000  1.0000  0.4000") and text[2].startswith("> m2") and len({len(x) for x in text}) == 1
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert storage.cached(spark, f"file://{tmp_path}/cached", make).count() == 3
    assert made == [1]


def test_question_detail(spark):
    rates = spark.createDataFrame([(1, 10, "a", 0.5), (1, 11, "a", 0.7), (1, 11, "b", 2.0), (1, 12, "b", 1.0)], "question_id long, article_id long, method string, weight double")
    answers = spark.createDataFrame([(1, 12)], "question_id long, article_id long")
    order = lambda k, smaller: [r["article_id"] for r in views.question_detail(rates, answers, [("a", False), ("b", smaller)], k).orderBy("place").collect()]
    assert order(1, True) == [11, 10, 12] and order(2, True) == [10, 12, 11] and order(2, False) == [11, 12, 10]


def test_categories_of_an_article_are_limited(spark):
    members = [(a, f"c{i:02}") for a in (1, 2) for i in range(14)] + [(3, "c00")]
    scores = [(9, a, w) for a, w in ((1, 1.0), (2, 0.5), (3, 4.0))]
    got = graph.propagate_categories(spark.createDataFrame(scores, "question_id long, article_id long, weight double"), spark.createDataFrame(members, "article_id long, category string"), 1.0)
    # c00 has three articles, 5.5 * 3; the others two, 1.5 * 2; of an article's fourteen categories the ten best count
    want = {1: (16.5 + 9 * 3.0) * 10, 2: (16.5 + 9 * 3.0) * 10, 3: 16.5}
    assert {r["article_id"]: r["weight"] for r in got.collect()} == want


def test_pairs_of_a_large_key_are_whole_and_spread(spark, monkeypatch):
    monkeypatch.setattr(graph, "PACKED", 8)
    one = spark.createDataFrame([(k, i, i / 2) for k, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)], "k long, a long, w double")
    other = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 2), (4, 1)) for i in range(n)] + [(None, 7)], "k long, b long")
    got = graph.paired(one, other, "k")
    want = [(a, a / 2, b) for n, m in ((40, 50), (3, 2)) for a in range(n) for b in range(m)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_scores_meet_few_categories_without_an_exchange_of_pairs(spark):
    scores = spark.createDataFrame([(q, a, (q * 7 + a) % 5 / 4) for q in range(30) for a in range(6)], "question_id long, article_id long, weight double")
    members = spark.createDataFrame([(a, c) for a in range(90) for c in ("x", f"y{a % 2}")] + [(None, "x"), (5, None)], "article_id long, category string")
    got = graph.propagate_categories(scores, members, 1.0, top=2, categories_top=1)
    best = lambda q, held: 2 * sum(sorted(((q * 7 + a) % 5 / 4 for a in held), reverse=True)[:2])
    of = {q: {"x": best(q, range(6)), "y0": best(q, (0, 2, 4)), "y1": best(q, (1, 3, 5))} for q in range(30)}
    want = [(q, a, max(of[q]["x"], of[q][f"y{a % 2}"])) for q in range(30) for a in range(90)] + [(q, None, of[q]["x"]) for q in range(30)]
    assert sorted(map(str, (tuple(r) for r in got.select("question_id", "article_id", "weight").collect()))) == sorted(map(str, want))
    # all that is exchanged are pieces
    assert "question_id" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x)


def test_answers_from_titles_pair_nothing_twice(spark):
    articles = spark.createDataFrame([(a, "Same" if a < 60 else f"t{a}" if a < 90 else None, 10 * (a % 3)) for a in range(100)], "article_id long, title string, words_count int")
    resolved = spark.createDataFrame([(a, a - a % 6) for a in range(100)], "article_id long, target long")
    wanted = spark.createDataFrame([(q, t) for q in range(40) for t in ("same", "SAME")] + [(50, "T62"), (50, "same"), (51, "t65"), (52, None), (53, "none"), (50, "t62")], "question_id long, title string")
    got = graph.answers_from_titles(wanted, articles, resolved, 0)
    want = {(q, a) for q in [*range(40), 50] for a in range(0, 60, 6)} | {(50, 60), (51, 60)}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    few = graph.answers_from_titles(wanted, articles.where("article_id <> 12").union(spark.createDataFrame([(12, "same", 5)], articles.schema)), resolved, 5)
    assert {tuple(r) for r in few.collect()} == {(q, 12) for q in [*range(40), 50]}
    # pairs are made last: no exchange and no aggregate stands after them
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "Aggregate [question_id" not in plan


def test_evolution_ranks_as_fitness_does_in_a_job_a_measurement(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(q, a, m, float(rng.integers(0, 4)) / 4) for q in range(12) for a in range(9) for m in ("x", "cosine", "z") if rng.random() < 0.7]
    rates = spark.createDataFrame(rows + [(0, 1, "x", 0.5), (1, 1, "z", None), (2, 1, "other", 9.0)], "question_id long, article_id long, method string, weight double")
    solved = spark.createDataFrame([(q, a) for q in range(11) for a in (2, 5, 20)] * 2, "question_id long, article_id long")
    people, methods = rng.random((7, 3)), ["x", "cosine", "z"]
    people[0] = 0
    parts = solved.where("question_id % 2 = 0"), solved.where("question_id % 2 = 1")
    made = storage.store(ensemble.by_question(rates, parts, methods), "by-question")
    table = spark.createDataFrame([(i, m, float(w)) for i, p in enumerate(people) for m, w in zip(methods, p)], "individual int, method string, w double")
    for which, part in enumerate(parts):
        want = {r["individual"]: r["mrr"] for r in ensemble.fitness(rates, part, table).collect()}
        assert ensemble.mean_ranks(spark, made, which, 2, people).tolist() == pytest.approx([want[i] for i in range(7)], abs=1e-11)
    plan = made.select("x", "golds")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert ensemble.mean_ranks(spark, made.where("question_id = 11"), 0, 2, people).tolist() == [0.0] * 7
    x, gold = rng.integers(0, 9, (600, 3)) / 8, np.array([0, 5, 599])
    ranks = ensemble.places(x, gold, people)
    monkeypatch.setattr(ensemble, "DIRECT", 0)
    assert (ranks == ensemble.places(x, gold, people)).all() and (ranks[:, 0] == 600).all() and ranks[0, 1] == (np.round(x @ people[1], 9) >= round(x[0] @ people[1], 9)).sum()


def test_gold_ranks_meet_no_score_with_each_answer(spark, monkeypatch):
    rng = np.random.default_rng(5)
    scores = spark.createDataFrame([(q, a, float(rng.integers(-3, 3)) / 7 + 1e-9 * a) for q in range(6) for a in range(-50, 150) if (q, a) != (2, 9)], "question_id long, article_id long, weight double")
    answers = spark.createDataFrame([(q, a) for q in (0, 1, 2, 4, 9) for a in (-50, 3, 9, 77, 149, 500)] * 2, "question_id long, article_id long")
    for most in (500_000, 7):
        monkeypatch.setattr(ranking, "SENT_ANSWERS", most)
        for smaller in (True, False):
            want = ranking.ranked(scores, smaller).join(answers.distinct(), ["question_id", "article_id"], "left_semi").select("question_id", "article_id", "position", "weight")
            got = ranking.gold_ranks(answers, scores, smaller)
            assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
            assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert ranking.gold_ranks(answers.limit(0), scores, True).count() == 0
