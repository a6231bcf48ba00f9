"""TF-IDF weights and the comparators over whole documents and sliding windows, for all questions at once.

Only words that questions have are ever counted, joined or exchanged: articles' words meet the questions' in the scan,
and rarity comes from the index's table of frequencies where there is one.  Vectors stay sparse: distances come from the
matched words and the questions' norms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import postings

SMALLER_FIRST = {"tf-idf": False, "cosine": True, "euclidean": True, "cityblock": True}
#: Rows of the questions' table (question, word) that are sent to every task at most.
SENT_ROWS = 1_000_000
#: Rows of (question, match) that a task looks at together.
STEP_ROWS = 2_000_000


def document_frequency(counts: DataFrame, n_articles: int) -> DataFrame:
    """(word, df, idf) with idf = ln(N / df), without smoothing, from (article_id, word) pairs."""
    return with_idf(counts.groupBy("word").agg(F.count("*").alias("df")), n_articles)


def with_idf(frequencies: DataFrame, n_articles: int) -> DataFrame:
    return frequencies.select("word", "df", F.log(F.lit(float(n_articles)) / F.col("df")).alias("idf"))


def term_counts(rows: DataFrame) -> DataFrame:
    """(article_id, word, c)."""
    return rows.groupBy("article_id", "word").agg(F.count("*").alias("c"))


def question_weights(questions: DataFrame, idf: DataFrame, min_idf: float = 0.0) -> DataFrame:
    """(question_id, word, qw, idf): count / number of words * idf; words that no article has, or of too small idf, go."""
    each = questions.select("question_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    counted = each.groupBy("question_id", "word", "n").agg(F.count("*").alias("c"))
    return counted.join(idf.where(F.col("idf") > min_idf), "word").select("question_id", "word", (F.col("c") / F.col("n") * F.col("idf")).alias("qw"), "idf")


def question_words(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.explode(F.array_distinct("words")).alias("word"))


def sent(df: DataFrame, questions: DataFrame) -> DataFrame:
    """df, which has at most a row for each word of each question, to be broadcast if those are few enough."""
    rows = questions.agg(F.sum(F.size("words"))).first()[0] or 0
    return F.broadcast(df) if rows <= SENT_ROWS else df


def asked(articles: DataFrame, questions: DataFrame) -> DataFrame:
    """(article_id, pos, word) of the articles' words that some question has; of the others nothing leaves the scan."""
    return postings(articles).join(sent(question_words(questions).select("word").distinct(), questions), "word", "left_semi")


def _weighed(sums: DataFrame, norms: DataFrame, comparator: str, power: float) -> DataFrame:
    """(question_id, article_id, weight) from sums s, k, dot, v2, d1 over matched words and norms (question_id, n2, n1)."""
    key = ["question_id", "article_id"]
    if comparator == "tf-idf":
        return sums.select(*key, (F.col("s") * F.pow("k", F.lit(power))).alias("weight"))
    joined = sums.join(norms, "question_id")
    v2, d1 = F.coalesce("v2", F.lit(0.0)), F.coalesce("d1", F.lit(0.0))
    if comparator == "cosine":
        return joined.where((v2 > 0) & (F.col("n2") > 0)).select(*key, (1 - F.col("dot") / F.sqrt(F.col("n2") * v2)).alias("weight"))
    if comparator == "euclidean":
        return joined.select(*key, F.sqrt(F.greatest(F.col("n2") - 2 * F.col("dot") + v2, F.lit(0.0))).alias("weight"))
    return joined.select(*key, (F.col("n1") + d1).alias("weight"))


def _distances(matched: DataFrame, norms: DataFrame, comparator: str, power: float) -> DataFrame:
    """matched: (question_id, article_id, c, idf, qw or null) a matched word; a word weighs c / all matched * idf.

    All matches of an article stand in one task, so they are summed there before anything is exchanged.
    """
    key = ["question_id", "article_id"]
    qw = F.coalesce("qw", F.lit(0.0))
    if comparator == "cityblock":  # not a sum of what each word gives until the total is known
        total = F.sum("c").over(Window.partitionBy(*key))
        w = F.col("c") / total * F.col("idf")
        each = matched.withColumn("d", F.when(F.col("qw").isNotNull(), F.abs(qw - w) - F.abs(qw)))
        return _weighed(each.groupBy(*key).agg(F.sum("d").alias("d1")), norms, comparator, power)
    w = F.col("c") * F.col("idf")
    sums = matched.groupBy(*key).agg(
        F.sum("c").alias("n"), F.sum(w).alias("s"), F.count("*").alias("k"), F.sum(w * qw).alias("dot"), F.sum(F.when(F.col("qw").isNotNull(), w * w)).alias("v2")
    )
    n = F.col("n")
    sums = sums.select(*key, (F.col("s") / n).alias("s"), "k", (F.col("dot") / n).alias("dot"), (F.col("v2") / n / n).alias("v2"), F.lit(0.0).alias("d1"))
    return _weighed(sums, norms, comparator, power)


def _norms(qw: DataFrame) -> DataFrame:
    return qw.groupBy("question_id").agg(F.sum(F.col("qw") * F.col("qw")).alias("n2"), F.sum(F.abs("qw")).alias("n1"))


def question_table(questions: DataFrame, idf: DataFrame, min_idf: float) -> tuple[DataFrame, DataFrame]:
    """(question_id, word, idf, qw or null) of all distinct words that articles have, and the question vectors' norms."""
    qw = question_weights(questions, idf, min_idf).select("question_id", "word", "qw")
    words = question_words(questions).join(idf.select("word", "idf"), "word").join(qw, ["question_id", "word"], "left")
    return words.select("question_id", "word", "idf", "qw"), _norms(qw)


def _rarity(articles: DataFrame, questions: DataFrame, n_articles: int, frequencies: DataFrame | None) -> DataFrame:
    """(word, idf) of the questions' words: looked up where there is a table (word, df), else counted."""
    if frequencies is None:
        return document_frequency(asked(articles, questions).select("article_id", "word").distinct(), n_articles)
    wanted = sent(question_words(questions).select("word").distinct(), questions)
    return with_idf(frequencies.join(wanted, "word", "left_semi"), n_articles)


def score_documents(questions: DataFrame, articles: DataFrame, n_articles: int, comparator: str = "tf-idf", power: float = 3.0, min_idf: float = 0.0, frequencies: DataFrame | None = None) -> DataFrame:
    """(question_id, article_id, weight), whole documents: w = c / matched positions * idf.

    questions: (question_id, words).  articles: (article_id, words).  frequencies: (word, df), if the index has them.
    """
    words, norms = question_table(questions, _rarity(articles, questions, n_articles, frequencies), min_idf)
    counts = term_counts(asked(articles, questions))
    return _distances(counts.join(sent(words, questions), "word"), norms, comparator, power)


def score_bigrams(questions: DataFrame, articles: DataFrame, n_articles: int, comparator: str = "tf-idf", power: float = 3.0, min_idf: float = 0.0) -> DataFrame:
    """As score_documents, over neighbouring words both of which the question has."""
    words = F.col("words")
    pair = lambda a, b: F.struct(a.alias("first"), b.alias("second"))
    pairs = articles.where(F.size(words) > 1).select("article_id", F.explode(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), pair)).alias("p"))
    pairs = pairs.select("article_id", "p.first", "p.second")
    known = question_words(questions).select("word").distinct()
    for side in ("first", "second"):
        pairs = pairs.join(sent(known.withColumnRenamed("word", side), questions), side, "left_semi")
    counts = pairs.groupBy("article_id", "first", "second").agg(F.count("*").alias("c"))
    text = F.concat_ws(" ", "first", "second").alias("word")
    idf = document_frequency(counts.select(text), n_articles)
    of = question_words(questions)
    owned = counts.join(sent(of.withColumnRenamed("word", "first"), questions), "first").join(sent(of.withColumnRenamed("word", "second"), questions), ["question_id", "second"])
    grams = questions.select("question_id", F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("words", i - 1), F.get("words", i))).alias("words"), F.size("words").alias("n"))
    qw = question_weights(grams.where("n > 1"), idf, min_idf).select("question_id", "word", "qw")
    matched = owned.select("question_id", "article_id", text, "c").join(idf.select("word", "idf"), "word").join(sent(qw, questions), ["question_id", "word"], "left")
    return _distances(matched, _norms(qw), comparator, power)


class Questions:
    """Questions' words as arrays: for each word of the vocabulary the questions that have it, with what it weighs there."""

    def __init__(self, table: list[tuple], norms: dict[int, tuple[float, float]]) -> None:
        """table: (question_id, word, idf, qw or None)."""
        self.ids = np.array(sorted({r[0] for r in table}), np.int64)
        number = {w: i for i, w in enumerate(sorted({r[1] for r in table}))}
        self.words = pa.array(list(number), pa.string())
        rows = sorted((number[w], q, idf, qw) for q, w, idf, qw in table)
        self.of = np.searchsorted(self.ids, np.array([r[1] for r in rows], np.int64))
        self.idf = np.array([r[2] for r in rows], float)
        self.qw = np.array([np.nan if r[3] is None else r[3] for r in rows], float)
        self.begin = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(len(number) + 1))
        self.norms = np.array([norms.get(int(q), (0.0, 0.0)) for q in self.ids], float).reshape(-1, 2)


def _windows(q: Questions, article: np.ndarray, pos: np.ndarray, word: np.ndarray, n: int, comparator: str, power: float, low: int, high: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Question number, article number, position and weight of the best windows, for questions low to high.

    Each match enters at its position and leaves n + 1 later; how often its word stands in the window then is found by
    halving, so each event says what the sums change by, and running totals are the windows' sums.
    """
    mine = (q.of >= low) & (q.of < high)
    begin = np.r_[0, np.cumsum(mine)][q.begin]
    degree = begin[word + 1] - begin[word]
    if int(degree.sum()) > STEP_ROWS and article[0] != article[-1]:
        half = int(np.searchsorted(article, article[len(article) // 2])) or int(np.searchsorted(article, article[0], side="right"))
        yield from _windows(q, article[:half], pos[:half], word[:half], n, comparator, power, low, high)
        yield from _windows(q, article[half:], pos[half:], word[half:], n, comparator, power, low, high)
        return
    if int(degree.sum()) > STEP_ROWS and high - low > 1:
        yield from _windows(q, article, pos, word, n, comparator, power, low, (low + high) // 2)
        yield from _windows(q, article, pos, word, n, comparator, power, (low + high) // 2, high)
        return
    match = np.repeat(np.arange(len(word)), degree)
    at = np.flatnonzero(mine)[np.arange(len(match)) - np.repeat(np.cumsum(degree) - degree, degree) + begin[word][match]]
    if not len(match):
        return
    key = article[match] * np.int64(len(q.ids)) + q.of[at]
    order = np.lexsort((pos[match], word[match], key))
    match, at, key = match[order], at[order], key[order]
    p, w, k, qw = pos[match], word[match], q.idf[at] / n, q.qw[at]
    wide = np.int64(p.max() + n + 2)
    run = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (w[1:] != w[:-1])]) * wide
    place, here = run + p, np.arange(len(p))
    after = here - np.searchsorted(place, run + np.maximum(p - n, 0)) + 1  # how often, once it has entered
    before = np.searchsorted(place, run + p + n, side="right") - here  # how often, before it leaves
    inside, x = ~np.isnan(qw), np.nan_to_num(qw)
    c = np.concatenate([after, before]).astype(float)
    sign = np.r_[np.ones(len(p)), -np.ones(len(p))]
    k, x, inside = np.tile(k, 2), np.tile(x, 2), np.tile(inside, 2)
    d1 = sign * (np.abs(x - k * c) - np.abs(x - k * (c - 1)))
    changes = np.stack([sign * k, sign * (c == 1), np.where(inside, sign * k * x, 0), np.where(inside, sign * k * k * (2 * c - 1), 0), np.where(inside, d1, 0)])
    time = np.concatenate([p, p + n + 1])
    dense = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    moment = np.tile(dense, 2) * wide + time
    order = np.argsort(moment, kind="stable")
    moment = moment[order]
    totals = np.concatenate([np.zeros((5, 1)), np.cumsum(changes[:, order], axis=1)], axis=1)
    s, distinct, dot, v2, d1 = totals[:, np.searchsorted(moment, dense * wide + p, side="right")] - totals[:, np.searchsorted(moment, dense * wide)]
    n2, n1 = q.norms[q.of[at]].T
    if comparator == "tf-idf":
        weight, good = s * np.round(distinct) ** power, np.ones(len(p), bool)
    elif comparator == "cosine":
        good = (v2 > 1e-12) & (n2 > 0)
        weight = 1 - dot / np.sqrt(np.where(good, n2 * v2, 1))
    elif comparator == "euclidean":
        weight, good = np.sqrt(np.maximum(n2 - 2 * dot + v2, 0)), n2 > 0
    else:
        weight, good = n1 + d1, n2 > 0
    # the first of the best windows, compared to nine decimals
    dense, p, weight, where = dense[good], p[good], weight[good], at[good]
    order = np.lexsort((p, np.round(weight if SMALLER_FIRST[comparator] else -weight, 9), dense))
    first = order[np.r_[True, dense[order][1:] != dense[order][:-1]]] if len(order) else order
    yield q.of[where[first]], article[match[good][first]], p[first], weight[first]


def score_windows(questions: DataFrame, articles: DataFrame, n_articles: int, n: int, comparator: str = "tf-idf", power: float = 3.0, min_idf: float = 0.0, frequencies: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """(question_id, article_id, pos, weight) of the best window of positions [p - n, p] that ends at a match.

    Questions are sent to the tasks in groups of at most SENT_ROWS words, one pass over the articles each; a task finds
    the matches of a batch of articles and the sums of all their windows at once.  The work is linear in the matches (but
    for sorting them) however wide the window.  With `top` a batch gives only the best of each question (weights to six
    decimals, then ids), since no others can be among the best of all.
    """
    words, norms = question_table(questions, _rarity(articles, questions, n_articles, frequencies), min_idf)
    rows = questions.agg(F.sum(F.size("words"))).first()[0] or 0
    groups = max(1, -(-rows // SENT_ROWS))
    out = None
    for g in range(groups):
        mine = F.pmod(F.xxhash64("question_id"), F.lit(groups)) == g
        table = [tuple(r) for r in words.where(mine).select("question_id", "word", "idf", "qw").collect()]
        known = Questions(table, {r[0]: (r[1], r[2]) for r in norms.where(mine).select("question_id", "n2", "n1").collect()})

        def best(batches: Iterator[pa.RecordBatch], q: Questions = known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                number = pc.index_in(lists.flatten(), value_set=q.words).fill_null(-1).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(number >= 0)
                if not len(hit):
                    continue
                article = np.repeat(np.arange(len(sizes)), sizes)[hit]
                pos = hit - (np.cumsum(sizes) - sizes)[article]
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for of, who, where, weight in _windows(q, article, pos.astype(np.int64), number[hit].astype(np.int64), n, comparator, power, 0, len(q.ids)):
                    if top is not None:
                        order = np.lexsort((ids[who], np.round(weight if SMALLER_FIRST[comparator] else -weight, 6), of))
                        sorted_of = of[order]
                        place = np.arange(len(order)) - np.searchsorted(sorted_of, sorted_of)
                        of, who, where, weight = (x[order[place < top]] for x in (of, who, where, weight))
                    yield pa.RecordBatch.from_arrays([pa.array(q.ids[of]), pa.array(ids[who]), pa.array(where), pa.array(weight)], names=["question_id", "article_id", "pos", "weight"])

        rows_of = articles.select(F.col("article_id").cast("long").alias("article_id"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))
        found = rows_of.mapInArrow(best, "question_id long, article_id long, pos long, weight double")
        out = found if out is None else out.unionByName(found)
    return out


def window_words(best: DataFrame, questions: DataFrame, articles: DataFrame, n: int) -> DataFrame:
    """(question_id, article_id, words): the distinct matched words of each best window, in order of the alphabet."""
    start = F.greatest(F.col("pos") - n, F.lit(0)).cast("int")
    inside = F.slice("words", start + 1, (F.col("pos") - start + 1).cast("int"))
    seen = articles.join(best.select("question_id", "article_id", "pos"), "article_id").select("question_id", "article_id", inside.alias("inside"))
    asked_for = questions.select("question_id", F.col("words").alias("asked"))
    words = F.array_sort(F.array_intersect("inside", "asked"))
    return seen.join(asked_for, "question_id").select("question_id", "article_id", F.array_join(words, " ").alias("words"))
