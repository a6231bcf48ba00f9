"""Rankings, windows, evaluation, vectors, views, graph, ensemble and learning queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ensemble, evaluate, graph, learn, ranking, tfidf, vectors
from ..operators import index as I
from ..sources import sinks
from ..storage import place, scope, store
from . import sql as S
from . import views
from .registry import query, table
from .views import counted_page

TOP = 3


_ingested: dict[tuple, tuple[str, str, list[str], int]] = {}


def _ingest(spark: SparkSession, sf: str) -> tuple[str, str, list[str], int]:
    """Where the index of `documents` is, its stop words and its number of articles.

    As a search engine's, the index is made once, here once a session and version of the table, and read by every query:
    articles' words without stop words, and how many articles have each word.
    """
    path = f"{sf}/documents.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where)
    changed = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()
    key = (spark.sparkContext.applicationId, path, files.getLength(), files.getFileCount(), changed)
    if key not in _ingested:
        with scope(spark, "articles", "vocabulary"):
            tokens = store(I.tokenized(table(spark, sf, "documents")), "tokens")
            stop = I.stop_words(tokens, tokens=F.col("content"))
            articles, vocabulary = place(spark, "articles"), place(spark, "vocabulary")
            I.articles(tokens, stop).write.parquet(articles)
            made = spark.read.parquet(articles)
            words = made.select(F.explode(F.array_distinct("content")).alias("word"))
            words.groupBy("word").agg(F.count("*").alias("df")).write.parquet(vocabulary)
            _ingested[key] = articles, vocabulary, stop, made.count()
    return _ingested[key]


class Corpus:
    """The index and the questions of the test tables."""

    def __init__(self, spark: SparkSession, sf: str, title: bool = False) -> None:
        articles, vocabulary, self.stop, self.n = _ingest(spark, sf)
        self.fields = spark.read.parquet(articles)
        self.articles = spark.read.parquet(articles).select("article_id", F.col("title" if title else "content").alias("words"))
        #: how many articles have a word in their text; titles are rarer, and counted where they are asked for
        self.frequencies = None if title else spark.read.parquet(vocabulary)
        self.vocabulary = spark.read.parquet(vocabulary)
        self.questions = I.questions(table(spark, sf, "benchmark"), self.stop)

    @property
    def postings(self) -> DataFrame:
        return I.postings(self.articles)

    def scores(self, comparator: str = "tf-idf", **more: float) -> DataFrame:
        return tfidf.score_documents(self.questions, self.articles, self.n, comparator, frequencies=self.frequencies, **more)

    def windows(self, n: int, comparator: str = "tf-idf", top: int | None = None) -> DataFrame:
        return tfidf.score_windows(self.questions, self.articles, self.n, n, comparator, frequencies=self.frequencies, top=top)


def shown(scores: DataFrame, comparator: str, k: int = TOP) -> DataFrame:
    best = ranking.top(scores, k, tfidf.SMALLER_FIRST[comparator])
    return best.select("question_id", "article_id", F.col("position").cast("long").alias("position"), (F.round("weight", 5) + 0.0).alias("weight"))  # no negative zero


def gold_answers(spark: SparkSession, sf: str) -> DataFrame:
    """(question_id, article_id): documents that hold an item's text.

    Items are looked for by up to four of their inner words (the first and last may be parts of a document's words): the
    hashes of runs of a document's words meet the items' by an equi-join, and of the few pairs that do the texts decide.
    Items of fewer than three words have no inner word and are looked for in each text as it is read.
    """
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    keyed = items.select(F.col("item_id").alias("question_id"), F.col("text").alias("item"), words(F.col("text")).alias("w"))
    keyed = keyed.withColumn("n", F.least(F.size("w") - 2, F.lit(4))).where("item is not null")
    sizes = sorted(r["n"] for r in keyed.select("n").distinct().collect())
    inner = keyed.where("n > 0").select("question_id", F.xxhash64(F.array_join(F.slice("w", F.lit(2), F.col("n")), " ")).alias("h"))
    texts = docs.select(F.col("doc_id").alias("article_id"), "text")
    parts = []
    if any(n > 0 for n in sizes):
        held = docs.select(F.col("doc_id").alias("article_id"), words(F.col("text")).alias("w"))
        run = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))).otherwise(F.array().cast("array<bigint>"))
        runs = held.select("article_id", F.explode(F.array_distinct(F.concat(*[run(n) for n in sizes if n > 0]))).alias("h"))
        met = runs.join(inner, "h").select("question_id", "article_id").distinct()
        parts.append(met.join(texts, "article_id").join(keyed.select("question_id", "item"), "question_id").where(F.col("text").contains(F.col("item"))).select("question_id", "article_id"))
    if any(n <= 0 for n in sizes):
        few = [(r["question_id"], r["item"]) for r in keyed.where("n <= 0").select("question_id", "item").collect()]
        listed = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(t).alias("item")) for i, t in few])
        parts.append(texts.select(F.explode(F.filter(listed, lambda x: F.col("text").contains(x["item"]))).alias("x"), "article_id").select(F.col("x.id").alias("question_id"), "article_id"))
    if not parts:
        return texts.limit(0).select(F.col("article_id").alias("question_id"), "article_id")
    found = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return found.distinct()


@query(f"{S.base()} SELECT word, df, round(idf, 6) AS idf FROM idf")
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    return tfidf.with_idf(c.vocabulary, c.n).select("word", "df", F.round("idf", 6).alias("idf"))


@query(f"{S.base()} SELECT question_id, word, round(qw, 6) AS qw FROM qw")
def question_weights(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    return tfidf.question_weights(c.questions, tfidf.with_idf(c.vocabulary, c.n)).select("question_id", "word", F.round("qw", 6).alias("qw"))


@query(S.document_rank("tf-idf"))
def tfidf_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    return shown(c.scores(), "tf-idf")


@query(S.document_rank("cosine"))
def cosine_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    return shown(c.scores("cosine"), "cosine")


@query(S.document_rank("euclidean"))
def euclidean_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    return shown(c.scores("euclidean"), "euclidean")


@query(S.document_rank("cityblock"))
def cityblock_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    return shown(c.scores("cityblock"), "cityblock")


@query(S.document_rank("cosine", min_idf=2.0))
def min_idf_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    return shown(c.scores("cosine", min_idf=2.0), "cosine")


BIGRAMS = """pairs AS (SELECT article_id, word || ' ' || second AS word FROM (SELECT article_id, word, lead(word) OVER (PARTITION BY article_id ORDER BY pos) AS second FROM post) WHERE second IS NOT NULL),
hits AS (SELECT question_id, article_id, pos, post.word FROM (SELECT DISTINCT question_id, word FROM qpost) q JOIN post USING (word)),
bigrams AS (SELECT question_id, article_id, a || ' ' || b AS word FROM (SELECT question_id, article_id, pos, word AS a, lead(word) OVER w AS b, lead(pos) OVER w AS p FROM hits WINDOW w AS (PARTITION BY question_id, article_id ORDER BY pos)) WHERE p = pos + 1),
bc AS (SELECT question_id, article_id, word, count(*) AS c FROM bigrams GROUP BY ALL),
bidf AS (SELECT word, ln(any_value(n.n)::DOUBLE / count(DISTINCT article_id)) AS idf FROM pairs, n WHERE word IN (SELECT word FROM bc) GROUP BY word),
qb AS (SELECT question_id, a || ' ' || b AS word FROM (SELECT question_id, word AS a, lead(word) OVER (PARTITION BY question_id ORDER BY pos) AS b FROM qpost) WHERE b IS NOT NULL),
bqw AS (SELECT question_id, word, count(*)::DOUBLE / any_value(t.n) * any_value(bidf.idf) AS qw FROM qb JOIN (SELECT question_id, count(*) AS n FROM qb GROUP BY question_id) t USING (question_id) JOIN bidf USING (word) WHERE bidf.idf > 0 GROUP BY ALL),
bnorms AS (SELECT question_id, sum(qw * qw) AS n2, sum(abs(qw)) AS n1 FROM bqw GROUP BY question_id),
weighted AS (SELECT question_id, article_id, word, c::DOUBLE / sum(c) OVER (PARTITION BY question_id, article_id) * idf AS w FROM bc JOIN bidf USING (word))"""


def _bigram_sql(comparator: str) -> str:
    return S.base(BIGRAMS, S.SUMS.replace("JOIN qw USING", "JOIN bqw USING"), S.rank_of(comparator, scored="sums LEFT JOIN bnorms USING (question_id)")).replace("coalesce(qw,", "coalesce(bqw.qw,")


@query(_bigram_sql("tf-idf"))
def bigram_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    return shown(tfidf.score_bigrams(c.questions, c.articles, c.n), "tf-idf")


@query(_bigram_sql("cosine"))
def bigram_cosine_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    return shown(tfidf.score_bigrams(c.questions, c.articles, c.n, "cosine"), "cosine")


TITLE_POST = f"""traw AS (SELECT doc_id AS article_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM (SELECT doc_id, {S.TOKENS.format("split_part(text, chr(10), 1)")} AS w FROM documents)),
kept0 AS (SELECT article_id FROM raw WHERE word NOT IN (SELECT word FROM stop) GROUP BY article_id HAVING count(*) >= 10),
post AS (SELECT article_id, word, row_number() OVER (PARTITION BY article_id ORDER BY p) - 1 AS pos FROM traw SEMI JOIN kept0 USING (article_id) WHERE word NOT IN (SELECT word FROM stop)),
n AS (SELECT count(*) AS n FROM kept0)"""


@query("WITH " + ",\n".join([S.RAW, S.STOP, TITLE_POST, S.QUESTIONS, S.WEIGHTS.format(min_idf=0.0), S.WEIGHTED, S.SUMS, S.rank_of("tf-idf")]))
def title_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf, title=True)
    return shown(c.scores(), "tf-idf")


@query(S.window_rank("tf-idf", 15))
def window_tfidf_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    return shown(c.windows(15, top=TOP), "tf-idf")


@query(S.window_rank("cosine", 15))
def window_cosine_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    return shown(c.windows(15, "cosine", top=TOP), "cosine")


@query(S.window_rank("tf-idf", 250))
def wide_window_tfidf_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    return shown(c.windows(250, top=TOP), "tf-idf")


@query(S.base(S.window_best("tf-idf", 15), """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(weight, 6) DESC, article_id) AS place FROM best) WHERE place <= 3)
SELECT t.question_id, t.article_id, string_agg(DISTINCT p.word, ' ' ORDER BY p.word) AS words FROM top t JOIN post p ON p.article_id = t.article_id AND p.pos BETWEEN t.pos - 15 AND t.pos
SEMI JOIN (SELECT DISTINCT question_id AS q, word AS w FROM qpost) q ON q.q = t.question_id AND q.w = p.word GROUP BY ALL"""))
def best_window_words(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    best = ranking.top(c.windows(15, top=TOP), TOP, False)
    return tfidf.window_words(best, c.questions, c.articles, 15)


RANKED_ALL = S.base(S.WEIGHTED, S.SUMS, f"""scores AS (SELECT question_id, article_id, {S.COMPARE["tf-idf"]} AS weight FROM sums LEFT JOIN norms USING (question_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(weight, 6) DESC, article_id) AS position FROM scores)""", S.GOLD)
SOLVED = """solved AS (SELECT question_id, article_id, coalesce(position, 100000) AS position, coalesce(weight, 0.0) AS weight FROM gold LEFT JOIN ranked USING (question_id, article_id))"""


def _tfidf_ranks(spark: SparkSession, sf: str, answers: DataFrame, k: int = 0) -> DataFrame:
    """Ranks of the answers, and of the k best."""
    scores = store(Corpus(spark, sf).scores(), "scores")
    gold = ranking.gold_ranks(answers, scores, False)
    return gold.unionByName(ranking.top(scores, k, False)).distinct() if k else gold


@query(f"WITH {S.GOLD} SELECT question_id, article_id FROM gold")
def gold(spark: SparkSession, sf: str) -> DataFrame:
    return gold_answers(spark, sf)


@query(f"{RANKED_ALL}, {SOLVED} SELECT question_id, article_id, position, round(weight, 5) AS weight FROM solved")
def solutions(spark: SparkSession, sf: str) -> DataFrame:
    answers = store(gold_answers(spark, sf), "answers")
    found = ranking.solutions(answers, _tfidf_ranks(spark, sf, answers), False)
    return found.select("question_id", "article_id", F.col("position").cast("long").alias("position"), F.round("weight", 5).alias("weight"))


@query(f"""{RANKED_ALL} SELECT question_id, article_id, round(coalesce(weight, 0.0), 5) AS weight FROM ranked FULL JOIN (SELECT *, true AS g FROM gold) USING (question_id, article_id) WHERE position <= 10 OR g""")
def rates_topk_gold(spark: SparkSession, sf: str) -> DataFrame:
    answers = store(gold_answers(spark, sf), "answers")
    found = ranking.rates(answers, _tfidf_ranks(spark, sf, answers, 10), 10, False)
    return found.select("question_id", "article_id", F.round("weight", 5).alias("weight"))


@query(f"{RANKED_ALL}, {SOLVED} SELECT 'tf-idf' AS method, count(*) AS answers, round(coalesce(avg((position <= 1)::INT), 0), 6) AS p_1, round(coalesce(avg((position <= 10)::INT), 0), 6) AS p_10, round(coalesce(avg((position <= 100)::INT), 0), 6) AS p_100, round(coalesce(avg(1.0::DOUBLE / position), 0), 6) AS mrr FROM solved")
def tfidf_report(spark: SparkSession, sf: str) -> DataFrame:
    answers = store(gold_answers(spark, sf), "answers")
    found = ranking.solutions(answers, _tfidf_ranks(spark, sf, answers), False)
    return evaluate.report(found.withColumn("method", F.lit("tf-idf")))


#: Rankings by events: users ask, articles are event_id % 50, methods are event types; purchases are gold.
EVENT_RANKS = f"""{S.RATES}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id, method ORDER BY round(weight, 6) DESC, article_id) AS position FROM rates),
answers AS (SELECT DISTINCT question_id, article_id FROM rates WHERE method = 'purchase'), sol AS (SELECT a.question_id, a.article_id, r.method, r.position FROM answers a JOIN r USING (question_id, article_id))"""


def event_rates(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("question_id"), (F.col("event_id") % 50).alias("article_id"), F.col("event_type").alias("method")).agg(F.avg("value").alias("weight"))


def event_ranks(spark: SparkSession, sf: str) -> DataFrame:
    place = Window.partitionBy("question_id", "method").orderBy(F.round("weight", 6).desc(), "article_id")
    return event_rates(spark, sf).withColumn("position", F.row_number().over(place))


def event_answers(spark: SparkSession, sf: str) -> DataFrame:
    return event_rates(spark, sf).where("method = 'purchase'").select("question_id", "article_id").distinct()


def event_solutions(spark: SparkSession, sf: str) -> DataFrame:
    return event_answers(spark, sf).join(event_ranks(spark, sf), ["question_id", "article_id"]).select("question_id", "article_id", "method", "position")


@query(f"WITH {EVENT_RANKS} SELECT method, round(avg((position <= 1)::INT), 6) AS p_1, round(avg((position <= 10)::INT), 6) AS p_10 FROM sol GROUP BY method")
def precision_at_n(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.report(event_solutions(spark, sf), (1, 10)).select("method", "p_1", "p_10")


@query(f"WITH {EVENT_RANKS} SELECT method, round(avg(1.0::DOUBLE / position), 6) AS mrr FROM sol GROUP BY method")
def mrr(spark: SparkSession, sf: str) -> DataFrame:
    return event_solutions(spark, sf).groupBy("method").agg(F.round(evaluate.mean_reciprocal_rank(F.col("position")), 6).alias("mrr"))


METRICS = f"""WITH {EVENT_RANKS}, m AS (SELECT method, count(*) AS answers, round(avg((position <= 1)::INT), 6) AS p_1, round(avg((position <= 10)::INT), 6) AS p_10, round(avg((position <= 100)::INT), 6) AS p_100, round(avg(1.0::DOUBLE / position), 6) AS mrr FROM sol GROUP BY method)"""


@query(f"{METRICS} SELECT * FROM m WHERE method <> 'signup'")
def method_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.report(ensemble.matching(event_solutions(spark, sf), exclude=["signup"]))


@query(f"{METRICS} SELECT method, 'p_1' AS metric, p_1 AS value FROM m UNION ALL SELECT method, 'p_10', p_10 FROM m UNION ALL SELECT method, 'p_100', p_100 FROM m UNION ALL SELECT method, 'mrr', mrr FROM m")
def metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.long_report(evaluate.report(event_solutions(spark, sf)))


@query("""SELECT item_id AS question_id, CAST(CASE WHEN place < a THEN 0 WHEN place < a + b THEN 1 ELSE 2 END AS BIGINT) AS part FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place FROM benchmark),
(SELECT CAST(round_even(count(*) * 0.6, 0) AS BIGINT) AS a, CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS b FROM benchmark)""")
def split_60_20_20(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"))
    return evaluate.split(items, (60, 20, 20), "question_id").select("question_id", F.col("part").cast("long").alias("part"))


@query(f"""WITH {EVENT_RANKS}, a AS (SELECT question_id, count(*) AS n FROM answers GROUP BY question_id), s AS (SELECT question_id, method, count(*) AS n FROM sol GROUP BY ALL)
SELECT a.question_id, m.method FROM a CROSS JOIN (SELECT DISTINCT event_type AS method FROM events) m LEFT JOIN s ON s.question_id = a.question_id AND s.method = m.method WHERE coalesce(s.n, 0) <> a.n""")
def unsolved_questions(spark: SparkSession, sf: str) -> DataFrame:
    methods = table(spark, sf, "events").select(F.col("event_type").alias("method")).distinct()
    return ranking.unsolved(event_answers(spark, sf), event_solutions(spark, sf), methods)


@query(f"""WITH {EVENT_RANKS}, p AS (SELECT DISTINCT question_id, position FROM sol WHERE method = 'purchase'),
runs AS (SELECT question_id, count(*) FILTER (position <= 9 AND position = place) AS run, count(*) AS n FROM (SELECT question_id, position, row_number() OVER (PARTITION BY question_id ORDER BY position) AS place FROM p) GROUP BY question_id)
SELECT round(sum(run)::DOUBLE / sum(n), 6) AS p1 FROM runs""")
def p1_leading_run(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.leading_run_p1(event_solutions(spark, sf).where("method = 'purchase'")).select(F.round("p1", 6).alias("p1"))


#: Word vectors of the test tables: the word of df-rank r has vector r.
VOCAB = """vocab AS (SELECT word, row_number() OVER (ORDER BY df DESC, word) - 1 AS vec_id FROM idf), vecs AS (SELECT word, embedding AS vec FROM vocab JOIN embeddings USING (vec_id)),
dims AS (SELECT word, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) AS dim FROM vecs)"""
QVEC = """qw0 AS (SELECT DISTINCT question_id, word FROM qpost), qvec AS (SELECT question_id, list(m ORDER BY dim) AS q FROM (SELECT question_id, dim, avg(x) AS m FROM qpost JOIN dims USING (word) GROUP BY ALL) GROUP BY question_id)"""


def word_vectors(spark: SparkSession, sf: str, vocabulary: DataFrame) -> DataFrame:
    """(word, vec) of the words that have a vector, numbered by df: only as many as there are vectors are taken."""
    e = table(spark, sf, "embeddings")
    have = e.agg(F.max("vec_id")).first()[0] + 1
    common = vocabulary.orderBy(F.desc("df"), "word").limit(have)
    numbered = common.withColumn("vec_id", (F.row_number().over(Window.orderBy(F.desc("df"), "word")) - 1).cast("long"))
    return store(numbered.join(e, "vec_id").select("word", F.col("embedding").cast("array<double>").alias("vec")), "vectors")


def _all_question_words(c: Corpus) -> DataFrame:
    return c.questions.select("question_id", F.explode("words").alias("word"))


@query(f"{S.base(VOCAB, QVEC)} SELECT question_id, round(list_sum(q), 5) AS total, round(q[1], 5) AS head, CAST(len(q) AS BIGINT) AS size FROM qvec")
def mean_vector(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    q = vectors.question_vectors(_all_question_words(c), word_vectors(spark, sf, c.vocabulary))
    return q.select("question_id", F.round(F.aggregate("qvec", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.get("qvec", F.lit(0)), 5).alias("head"), F.size("qvec").cast("long").alias("size"))


W2V_RANK = """dist AS (SELECT a.question_id, a.article_id, 1 - list_dot_product(a.v, q.q) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(q.q, q.q)) AS weight FROM avec a JOIN qvec q USING (question_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(weight, 6), article_id) AS position FROM dist) SELECT question_id, article_id, position, round(weight, 5) AS weight FROM r WHERE position <= 3"""


def _avec(words: str) -> str:
    return f"""shared AS (SELECT DISTINCT q.question_id, p.article_id, p.word FROM {words} q JOIN post p USING (word)),
avec AS (SELECT question_id, article_id, list(m ORDER BY dim) AS v FROM (SELECT question_id, article_id, dim, avg(x) AS m FROM shared JOIN dims USING (word) GROUP BY ALL) GROUP BY ALL)"""


@query(S.base(VOCAB, QVEC, _avec("qw0"), W2V_RANK))
def w2v_rank_top0(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    found = vectors.rank_common_words(_all_question_words(c), c.articles, word_vectors(spark, sf, c.vocabulary), TOP)
    return shown(found, "cosine")


SIMILAR = """given AS (SELECT DISTINCT word FROM qpost), near AS (SELECT a.word, b.word AS near_word, row_number() OVER (PARTITION BY a.word ORDER BY round(1 - list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 9), b.word) AS place
FROM (SELECT * FROM vecs SEMI JOIN given USING (word)) a JOIN vecs b ON a.word <> b.word), sim AS (SELECT word, near_word FROM near WHERE place <= 10 UNION SELECT word, word FROM given)"""


@query(f"{S.base(VOCAB, SIMILAR)} SELECT word, near_word FROM sim")
def similar_words_topn(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    return vectors.similar_words(_all_question_words(c), word_vectors(spark, sf, c.vocabulary), 10).withColumnRenamed("similar", "near_word")


@query(S.base(VOCAB, QVEC, SIMILAR, "qexp AS (SELECT DISTINCT q.question_id, sim.near_word AS word FROM qw0 q JOIN sim ON sim.word = q.word)", _avec("qexp"), W2V_RANK))
def w2v_rank_topn(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    vecs, words = word_vectors(spark, sf, c.vocabulary), _all_question_words(c)
    near = vectors.similar_words(words, vecs, 10)
    expanded = words.join(near, "word").select("question_id", F.col("similar").alias("word")).distinct()
    return shown(vectors.rank_common_words(words, c.articles, vecs, TOP, expanded), "cosine")


@query(S.base(VOCAB, QVEC, """mvec AS (SELECT article_id, list(m ORDER BY dim) AS v FROM (SELECT article_id, dim, avg(x) AS m FROM post JOIN dims USING (word) GROUP BY ALL) GROUP BY ALL),
dist AS (SELECT q.question_id, a.article_id, round(1 - list_cosine_similarity(a.v, q.q), 9) AS weight FROM mvec a, qvec q), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY weight, article_id) AS position FROM dist)
SELECT question_id, article_id, round(weight, 5) AS weight FROM r WHERE position <= 3"""))
def w2v_rank_all(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    found = vectors.score_all_words(_all_question_words(c), c.articles, word_vectors(spark, sf, c.vocabulary), TOP)
    return found.select("question_id", "article_id", F.round("weight", 5).alias("weight"))


@query(S.base(VOCAB, """forms AS (SELECT DISTINCT b AS base, c AS changed FROM (SELECT word AS b, lead(word) OVER (PARTITION BY article_id ORDER BY p) AS c FROM raw)
WHERE b <> c AND b[1:3] = c[1:3] AND regexp_full_match(b, '\\p{L}{3,}') AND regexp_full_match(c, '\\p{L}{3,}')),
lack AS (SELECT word FROM vocab ANTI JOIN vecs USING (word)), fb AS (SELECT l.word, d.dim, avg(d.x) AS x FROM lack l JOIN forms f ON f.changed = l.word JOIN dims d ON d.word = f.base GROUP BY ALL)
SELECT word, round(sum(x), 5) AS total FROM (SELECT word, x FROM dims UNION ALL SELECT word, x FROM fb) GROUP BY word"""))
def vector_fallback(spark: SparkSession, sf: str) -> DataFrame:
    c = Corpus(spark, sf)
    found = vectors.with_fallback(c.vocabulary, word_vectors(spark, sf, c.vocabulary), I.word_forms(table(spark, sf, "documents")))
    return found.select("word", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT doc_id AS article_id, title FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents WHERE doc_id % 3 <> 0 AND n_chars >= 1) ORDER BY title DESC, doc_id LIMIT 20 OFFSET 10")
def articles_page(spark: SparkSession, sf: str) -> DataFrame:
    from .views import page

    docs = table(spark, sf, "documents").where("doc_id % 3 <> 0 and n_chars >= 1").select(F.col("doc_id").alias("article_id"), T.title_of(F.col("text")).alias("title"))
    return page(docs, "-title", 2, 10, 20, "article_id")


@query(f"WITH {S.GOLD} SELECT g.article_id, g.question_id, left(b.text, 49) || CASE WHEN length(b.text) > 50 THEN '…' ELSE substr(b.text, 50) END AS name FROM gold g JOIN benchmark b ON b.item_id = g.question_id")
def article_questions(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), T.shortened(F.col("text")).alias("name"))
    return gold_answers(spark, sf).join(items, "question_id").select("article_id", "question_id", "name")


def _event_methods(spark: SparkSession, sf: str) -> list[str]:
    return sorted(r[0] for r in table(spark, sf, "events").select("event_type").distinct().collect())


@query(f"WITH {S.RATES} SELECT question_id, article_id, max(weight) FILTER (method = 'click') AS click, max(weight) FILTER (method = 'view') AS view FROM rates GROUP BY ALL".replace("AS click", "AS click_w").replace("AS view", "AS view_w").replace("max(weight) FILTER (method = 'click')", "round(coalesce(max(weight) FILTER (method = 'click'), -1e9), 5)").replace("max(weight) FILTER (method = 'view')", "round(coalesce(max(weight) FILTER (method = 'view'), -1e9), 5)"))
def question_pivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = event_rates(spark, sf).groupBy("question_id", "article_id").pivot("method", ["click", "view"]).agg(F.max("weight"))
    fill = lambda c: F.round(F.coalesce(c, F.lit(-1e9)), 5).alias(f"{c}_w")
    return wide.select("question_id", "article_id", F.round(F.coalesce("click", F.lit(-1e9)), 5).alias("click_w"), F.round(F.coalesce("view", F.lit(-1e9)), 5).alias("view_w"))


@query(f"WITH {EVENT_RANKS} SELECT a.question_id, a.article_id, coalesce(r.position, -1) AS position FROM answers a LEFT JOIN (SELECT * FROM r WHERE method = 'click') r USING (question_id, article_id)")
def gold_positions(spark: SparkSession, sf: str) -> DataFrame:
    clicks = event_ranks(spark, sf).where("method = 'click'").select("question_id", "article_id", "position")
    return event_answers(spark, sf).join(clicks, ["question_id", "article_id"], "left").select("question_id", "article_id", F.coalesce(F.col("position").cast("long"), F.lit(-1).cast("long")).alias("position"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events")
def table_stats(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.table_stats({t: table(spark, sf, t) for t in ("documents", "benchmark", "conversations", "embeddings", "pages", "events")})


#: Method names of the test tables: a setting for each event.
NAME = "'abc, type: ' || CASE event_id % 3 WHEN 0 THEN 'tfi' WHEN 1 THEN 'w2v' ELSE 'cnn' END || ', title: ' || (event_id % 2) || ', ngram: ' || (event_id % 2 + 1) || ', n: 0' || (10 + event_id % 7) || CASE event_id % 4 WHEN 0 THEN ', m: cosine' WHEN 1 THEN ', pf: 3.00' WHEN 2 THEN ', m: euclidean' ELSE ', topn: 10' END"


def _method_names(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    name = F.concat(F.lit("abc, type: "), F.when(i % 3 == 0, "tfi").when(i % 3 == 1, "w2v").otherwise("cnn"), F.lit(", title: "), i % 2, F.lit(", ngram: "), i % 2 + 1, F.lit(", n: 0"), i % 7 + 10, F.when(i % 4 == 0, ", m: cosine").when(i % 4 == 1, ", pf: 3.00").when(i % 4 == 2, ", m: euclidean").otherwise(", topn: 10"))
    return table(spark, sf, "events").select(name.alias("method")).distinct()


@query(f"SELECT DISTINCT method, regexp_matches(method, 'w2v|vector|euclidean|cosine|city') AS is_smaller_first FROM (SELECT {NAME} AS method FROM events)")
def method_direction(spark: SparkSession, sf: str) -> DataFrame:
    return _method_names(spark, sf).select("method", T.smaller_first(F.col("method")).alias("is_smaller_first"))


@query(f"""SELECT DISTINCT method, CASE WHEN contains(method, 'cnn') THEN 'CNN' WHEN contains(method, 'w2v') THEN 'w2v ' || coalesce(nullif(regexp_extract(method, 'topn: (\\d+)', 1), ''), '0') WHEN contains(method, 'cosine') THEN 'cosine' WHEN contains(method, 'euclidean') THEN 'euclidean' ELSE 'TF-IDF' END
|| CASE WHEN contains(method, 'title: 1') THEN ' title' ELSE '' END || CASE WHEN contains(method, 'ngram: 2') THEN ' bigram' ELSE '' END || ' n=' || regexp_extract(method, ', n: 0(\\d+)', 1) AS label FROM (SELECT {NAME} AS method FROM events)""")
def method_label(spark: SparkSession, sf: str) -> DataFrame:
    return _method_names(spark, sf).select("method", T.method_label(F.col("method")).alias("label"))


@query("SELECT event_id, 'abc, type: tfi, title: ' || (event_id % 2) || ', ngram: ' || (event_id % 2 + 1) || ', mwiw: 0.50, n: ' || lpad((event_id % 250)::VARCHAR, 3, '0') || CASE WHEN event_id % 2 = 0 THEN ', pf: 3.00' ELSE ', m: cosine' END AS method FROM events")
def method_names(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    name = T.method_name("abc", (i % 2).cast("int"), (i % 2 + 1).cast("int"), F.lit(0.5), (i % 250).cast("int"), F.when(i % 2 == 0, "tf-idf").otherwise("cosine"), F.lit(3.0))
    return table(spark, sf, "events").select("event_id", name.alias("method"))


@query(f"SELECT DISTINCT replace(method, 'type: tfi', 'type: tf-idf') AS method FROM (SELECT {NAME} AS method FROM events)")
def rename_methods(spark: SparkSession, sf: str) -> DataFrame:
    return _method_names(spark, sf).select(F.replace("method", F.lit("type: tfi"), F.lit("type: tf-idf")).alias("method")).distinct()


@query("SELECT doc_id FROM documents WHERE text ILIKE '%license%'")
def search_contains(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("text").ilike("%license%")).select("doc_id")


REDIRECT = "CASE WHEN doc_id % 3 = 0 THEN doc_id // 2 WHEN doc_id % 50 = 1 THEN doc_id + 1 WHEN doc_id % 50 = 2 THEN doc_id - 1 END"


def _redirects(spark: SparkSession, sf: str) -> DataFrame:
    to = F.when(F.col("article_id") % 3 == 0, F.floor(F.col("article_id") / 2)).when(F.col("article_id") % 50 == 1, F.col("article_id") + 1).when(F.col("article_id") % 50 == 2, F.col("article_id") - 1)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("article_id")).select("article_id", to.cast("long").alias("redirected_to")).where("redirected_to is not null")


@query(f"""WITH RECURSIVE e AS (SELECT doc_id AS a, {REDIRECT} AS b FROM documents WHERE {REDIRECT} IS NOT NULL AND {REDIRECT} <> doc_id),
walk AS (SELECT doc_id AS origin, doc_id AS here, [doc_id] AS seen FROM documents UNION ALL SELECT w.origin, e.b, list_append(w.seen, e.b) FROM walk w JOIN e ON e.a = w.here WHERE NOT list_contains(w.seen, e.b)),
ends AS (SELECT origin, arg_max(here, len(seen)) AS here, arg_max(seen, len(seen)) AS seen FROM walk GROUP BY origin)
SELECT origin AS article_id, CASE WHEN here IN (SELECT a FROM e) THEN list_min(seen) ELSE here END AS target FROM ends""")
def redirect_resolution(spark: SparkSession, sf: str) -> DataFrame:
    articles = table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"))
    return graph.resolve_redirects(_redirects(spark, sf), articles).select("article_id", "target")


@query(f"""WITH {S.RAW}, t AS (SELECT doc_id AS article_id, lower(split_part(text, chr(10), 1)) AS t FROM documents), w AS (SELECT article_id, count(*) AS n FROM raw GROUP BY article_id)
SELECT DISTINCT d.doc_id AS question_id, CASE WHEN t.article_id % 2 = 0 THEN t.article_id ELSE t.article_id - 1 END AS article_id FROM documents d JOIN t ON t.t = lower(split_part(d.text, chr(10), 1))
WHERE CASE WHEN t.article_id % 2 = 0 THEN t.article_id ELSE t.article_id - 1 END IN (SELECT article_id FROM w WHERE n >= 200)""")
def answers_from_titles(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    title = T.title_of(F.col("text"))
    articles = store(docs.select(F.col("doc_id").alias("article_id"), title.alias("title"), F.size(T.article_tokens(F.col("text"))).alias("words_count")), "titles")
    edges = articles.where("article_id % 2 = 1").select("article_id", (F.col("article_id") - 1).alias("redirected_to"))
    resolved = graph.resolve_redirects(edges, articles)
    return graph.answers_from_titles(articles.select(F.col("article_id").alias("question_id"), "title"), articles, resolved, 200)


LINKS = "edges AS (SELECT DISTINCT l_partkey % 50 AS src, l_suppkey % 50 AS dst FROM lineitem), scores AS (SELECT user_id AS question_id, event_id % 50 AS article_id, max(value) AS weight FROM events GROUP BY ALL)"


def _links(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    edges = table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("src"), (F.col("l_suppkey") % 50).alias("dst")).distinct()
    scores = table(spark, sf, "events").groupBy(F.col("user_id").alias("question_id"), (F.col("event_id") % 50).alias("article_id")).agg(F.max("value").alias("weight"))
    return scores, edges


def _link_sql(to: str, of: str) -> str:
    return f"""WITH {LINKS}, f AS (SELECT s.question_id, e.{to} AS article_id, s.weight, row_number() OVER (PARTITION BY s.question_id, e.{to} ORDER BY round(s.weight, 6) DESC, s.article_id) AS place FROM scores s JOIN edges e ON e.{of} = s.article_id)
SELECT question_id, article_id, round(sum(weight) * sqrt(count(*)), 4) AS weight FROM f WHERE place <= 10 GROUP BY ALL"""


@query(_link_sql("src", "dst"))
def link_forward(spark: SparkSession, sf: str) -> DataFrame:
    return graph.propagate_links(*_links(spark, sf), 0.5).select("question_id", "article_id", F.round("weight", 4).alias("weight"))


@query(_link_sql("dst", "src"))
def link_reverse(spark: SparkSession, sf: str) -> DataFrame:
    return graph.propagate_links(*_links(spark, sf), 0.5, reverse=True).select("question_id", "article_id", F.round("weight", 4).alias("weight"))


#: A document is in the categories of its source, its language and its id's remainder; each counts its two best.
MEMBERS = "m AS (SELECT doc_id AS article_id, unnest(list_distinct([source, lang, 'm' || (doc_id % 5)])) AS category FROM documents)"


@query(f"""WITH scores AS (SELECT user_id AS question_id, event_id % 50 AS article_id, max(value) AS weight FROM events GROUP BY ALL), {MEMBERS},
f AS (SELECT question_id, category, weight, row_number() OVER (PARTITION BY question_id, category ORDER BY round(weight, 6) DESC, s.article_id) AS place FROM scores s JOIN m ON m.article_id = s.article_id),
c AS (SELECT question_id, category, sum(weight) * sqrt(count(*)) AS weight FROM f WHERE place <= 10 GROUP BY ALL),
g AS (SELECT question_id, article_id, weight, row_number() OVER (PARTITION BY question_id, article_id ORDER BY round(weight, 6) DESC, category) AS place FROM m JOIN c USING (category))
SELECT question_id, article_id, round(sum(weight) * sqrt(count(*)), 4) AS weight FROM g WHERE place <= 2 GROUP BY ALL""")
def category_propagation(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array_distinct(F.array("source", "lang", F.concat(F.lit("m"), F.col("doc_id") % 5)))
    members = table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), F.explode(names).alias("category"))
    found = graph.propagate_categories(_links(spark, sf)[0], members, 0.5, categories_top=2)
    return found.select("question_id", "article_id", F.round("weight", 4).alias("weight"))


NORMAL = f"""{S.RATES}, x AS (SELECT *, coalesce(CASE WHEN m = 0 THEN weight WHEN regexp_matches(method, 'w2v|vector|euclidean|cosine|city') THEN 1 - weight / m ELSE weight / m END, 0) AS x FROM (SELECT *, max(weight) OVER (PARTITION BY question_id, method) AS m FROM rates))"""


@query(f"WITH {NORMAL} SELECT question_id, article_id, method, round(x, 7) AS x FROM x")
def normalise_weights(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.normalised(event_rates(spark, sf)).select("question_id", "article_id", "method", F.round("x", 7).alias("x"))


def _weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("click", 0.5), ("view", 0.25), ("purchase", 1.0)], "method string, w double")


W_SQL = "w AS (SELECT * FROM (VALUES ('click', 0.5::DOUBLE), ('view', 0.25), ('purchase', 1.0)) t(method, w))"


@query(f"WITH {NORMAL}, {W_SQL} SELECT question_id, article_id, round(sum(w * x), 5) AS weight FROM x JOIN w USING (method) GROUP BY ALL")
def ensemble_score(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.score(event_rates(spark, sf), _weights(spark)).select("question_id", "article_id", F.round("weight", 5).alias("weight"))


@query(f"WITH {NORMAL}, {W_SQL}, s AS (SELECT question_id, article_id, round(sum(w * x), 5) AS weight FROM x JOIN w USING (method) GROUP BY ALL) SELECT question_id, article_id, count(*) OVER (PARTITION BY question_id ORDER BY weight DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position FROM s")
def tie_rank(spark: SparkSession, sf: str) -> DataFrame:
    s = ensemble.score(event_rates(spark, sf), _weights(spark)).withColumn("weight", F.round("weight", 5))
    return s.select("question_id", "article_id", ranking.pessimistic_rank(F.col("weight"), "question_id").alias("position"))


@query(f"SELECT DISTINCT method FROM (SELECT {NAME} AS method FROM events) WHERE contains(method, 'type: tfi') AND contains(method, 'title: 0') AND NOT contains(method, 'cosine')")
def method_selection(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.matching(_method_names(spark, sf), ["type: tfi", "title: 0"], ["cosine"])


@query("SELECT doc_id, dense_rank() OVER (ORDER BY source) AS rank FROM documents")
def dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Sources are numbered among themselves first; the numbers then meet the documents."""
    docs = table(spark, sf, "documents")
    names = docs.select("source").distinct()
    ranked = names.select(F.col("source").alias("name"), F.dense_rank().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long").alias("rank"))
    return docs.join(ranked, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "rank")


@query(f"""WITH {EVENT_RANKS}, {NORMAL.split(', ', 1)[0] and NORMAL[NORMAL.index('x AS'):]}, k AS (SELECT x.question_id, x.article_id, x.method, x.x FROM x LEFT JOIN sol USING (question_id, article_id, method) WHERE sol.position IS NULL OR sol.position <= 2)
SELECT question_id, article_id, round(coalesce(max(x) FILTER (method = 'click'), 0), 7) AS click, round(coalesce(max(x) FILTER (method = 'view'), 0), 7) AS view, (question_id, article_id) IN (SELECT (question_id, article_id) FROM sol) AS is_gold FROM k GROUP BY ALL""")
def ea_dataset(spark: SparkSession, sf: str) -> DataFrame:
    found = ensemble.dataset(event_rates(spark, sf), event_solutions(spark, sf), ["click", "view"], worst=2)
    return found.select("question_id", "article_id", F.round("click", 7).alias("click"), F.round("view", 7).alias("view"), "is_gold")


POPULATION = [(0, "click", 1.0), (0, "view", 0.0), (1, "click", 0.5), (1, "purchase", 0.5), (2, "view", 1.0), (2, "purchase", 0.25)]


@query(f"""WITH {EVENT_RANKS}, {NORMAL[NORMAL.index('x AS'):]}, pop AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{m}', {w}::DOUBLE)" for i, m, w in POPULATION)}) t(individual, method, w)),
s AS (SELECT individual, question_id, article_id, round(sum(w * x), 9) AS weight FROM x JOIN pop USING (method) GROUP BY ALL),
r2 AS (SELECT *, count(*) OVER (PARTITION BY individual, question_id ORDER BY weight DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position FROM s)
SELECT individual::BIGINT AS individual, round(avg(1.0::DOUBLE / position), 6) AS mrr FROM r2 SEMI JOIN answers USING (question_id, article_id) GROUP BY individual""")
def ea_fitness_population(spark: SparkSession, sf: str) -> DataFrame:
    people = spark.createDataFrame(POPULATION, "individual int, method string, w double")
    found = ensemble.fitness(event_rates(spark, sf), event_solutions(spark, sf), people)
    return found.select(F.col("individual").cast("long").alias("individual"), F.round("mrr", 6).alias("mrr"))


@query()
def ea_search(spark: SparkSession, sf: str) -> DataFrame:
    """The search over all methods at the operator's own size; the weights it finds depend on the seed only."""
    rates, solved = event_rates(spark, sf), store(event_solutions(spark, sf), "solved")
    methods = _event_methods(spark, sf)
    rates = rates.where(F.col("method").isin(methods))
    best, most = ensemble.evolve(spark, rates, solved.where("question_id % 2 = 0"), solved.where("question_id % 2 = 1"), methods)
    return spark.createDataFrame([(m, w, most) for m, w in sorted(best.items())], "method string, w double, mrr double")


CLICKS = "c AS (SELECT * FROM r WHERE method = 'view')"


@query(f"""WITH {EVENT_RANKS}, {CLICKS}, o AS (SELECT question_id, article_id, row_number() OVER (PARTITION BY question_id ORDER BY position, article_id) AS place FROM c ANTI JOIN answers USING (question_id, article_id)),
g AS (SELECT question_id, count(*) AS n FROM answers GROUP BY question_id) SELECT question_id, article_id FROM o JOIN g USING (question_id) WHERE place > 1 AND place <= 1 + n""")
def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return learn.hard_negatives(event_ranks(spark, sf).where("method = 'view'"), event_answers(spark, sf), skip=1)


@query(f"""WITH {EVENT_RANKS}, {CLICKS}, o AS (SELECT question_id, article_id, row_number() OVER (PARTITION BY question_id ORDER BY position, article_id) AS place FROM c ANTI JOIN answers USING (question_id, article_id)),
g AS (SELECT question_id, count(*) AS n FROM answers GROUP BY question_id) SELECT question_id, article_id, 0::BIGINT AS target FROM o JOIN g USING (question_id) WHERE place > 1 AND place <= 1 + n UNION ALL SELECT question_id, article_id, 1 FROM answers""")
def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    negatives = learn.hard_negatives(event_ranks(spark, sf).where("method = 'view'"), event_answers(spark, sf), skip=1)
    pairs = learn.training_pairs(event_answers(spark, sf), negatives)
    return pairs.select("question_id", "article_id", F.col("target").cast("long").alias("target"))


@query(f"""WITH {S.GOLD}, a AS (SELECT doc_id AS article_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents),
d AS (SELECT question_id, ('0x' || left(md5(question_id || ':' || article_id || ':' || i || ':10'), 15))::BIGINT % (SELECT count(*) FROM documents) AS place FROM gold, (SELECT unnest([1, 2, 3]) AS i))
SELECT DISTINCT question_id, a.article_id FROM d JOIN a USING (place) ANTI JOIN gold g ON g.question_id = d.question_id AND g.article_id = a.article_id""")
def random_negatives(spark: SparkSession, sf: str) -> DataFrame:
    articles = table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"))
    return learn.random_negatives(articles, gold_answers(spark, sf), ratio=3)


@query("SELECT item_id, row_number() OVER (ORDER BY md5(item_id || ':10'), item_id) AS place FROM benchmark QUALIFY place <= 50")
def permuted_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 of a random order."""
    first = learn.permuted(table(spark, sf, "benchmark").select("item_id"), "item_id").limit(50)
    return first.select("item_id", F.row_number().over(Window.orderBy(F.md5(F.concat_ws(":", "item_id", F.lit(10))), "item_id")).cast("long").alias("place"))


@query("SELECT item_id AS question_id, left(text, 49) || CASE WHEN length(text) > 50 THEN '…' ELSE substr(text, 50) END AS name, (SELECT count(*) FROM benchmark) AS total_count FROM benchmark ORDER BY text DESC, item_id LIMIT 20")
def questions_page(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    return counted_page(items, "-text", 1, 20, 20, "question_id").select("question_id", T.shortened(F.col("text")).alias("name"), "total_count")


@query(f"WITH m AS (SELECT DISTINCT {NAME} AS method FROM events) SELECT method, (SELECT count(*) FROM m WHERE contains(method, 'title: 1')) AS total_count FROM m WHERE contains(method, 'title: 1') ORDER BY method LIMIT 15 OFFSET 10")
def methods_page(spark: SparkSession, sf: str) -> DataFrame:
    enabled = _method_names(spark, sf).where(F.col("method").contains("title: 1"))
    return counted_page(enabled, "method", 2, 10, 15, "method")


@query("SELECT word AS ngram, count(*) AS n FROM (SELECT unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) AS word FROM (SELECT " + S.ITEM_TOKENS + " AS w FROM benchmark) WHERE len(w) >= 2) GROUP BY 1")
def question_ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    words = T.question_tokens(T.clean_question(F.col("text")))
    return table(spark, sf, "benchmark").select(F.explode(T.ngrams(words, 2)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


SHOWN_METHODS = ("click", "purchase", "view")


@query(f"""WITH {EVENT_RANKS}, w AS (SELECT question_id, article_id, coalesce(max(weight) FILTER (method = 'click'), -1e9) AS w1, coalesce(max(weight) FILTER (method = 'purchase'), -1e9) AS w2, coalesce(max(weight) FILTER (method = 'view'), -1e9) AS w3
FROM rates WHERE method IN ('click', 'purchase', 'view') GROUP BY ALL)
SELECT question_id, article_id, round(w1, 5) AS w1, round(w2, 5) AS w2, round(w3, 5) AS w3, row_number() OVER (PARTITION BY question_id ORDER BY w3, article_id) AS place, (question_id, article_id) IN (SELECT (question_id, article_id) FROM answers) AS is_answer FROM w""")
def question_detail(spark: SparkSession, sf: str) -> DataFrame:
    """By the third method, taken as one whose smaller weights are better."""
    found = views.question_detail(event_rates(spark, sf), event_answers(spark, sf), [(m, m == "view") for m in SHOWN_METHODS], 3)
    return found.select("question_id", "article_id", *[F.round(f"w{i}", 5).alias(f"w{i}") for i in (1, 2, 3)], F.col("place").cast("long").alias("place"), "is_answer")


@query(f"""{RANKED_ALL}, {SOLVED} SELECT question_id, article_id, position, round(weight, 5) AS weight, ', type: tfi, title: 0, ngram: 1, mwiw: 0.00, n: 000, pf: 3.00' AS method FROM solved""")
def resolved_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Solutions of one method of a grid, by way of its tables."""
    from .resolve import Grid, resolve

    c, out = Corpus(spark, sf), place(spark, "resolved")
    resolve(spark, c.questions, c.articles, c.n, store(gold_answers(spark, sf), "answers"), Grid(), out, frequencies=c.frequencies)
    found = spark.read.parquet(f"{out}/solutions")
    return found.select("question_id", "article_id", F.col("position").cast("long").alias("position"), F.round("weight", 5).alias("weight"), "method")


@query("WITH l AS (SELECT *, n_chars > 2000 AS p FROM labels JOIN documents USING (doc_id)) SELECT count(*) AS n, round(avg((p::INT = quality)::INT), 6) AS accuracy FROM l")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    p = (F.col("n_chars") > 2000).cast("double")
    return rows.agg(F.count("*").alias("n"), F.round(evaluate.accuracy(p, F.col("quality")), 6).alias("accuracy"))


@query("SELECT DISTINCT event_type AS method, '2024' AS added FROM events WHERE event_type NOT IN ('view', 'click')")
def insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "events").select(F.col("event_type").alias("method"), F.lit("2024").alias("added"))
    existing = spark.createDataFrame([("view", "2020"), ("click", "2020")], "method string, added string")
    return sinks.absent(new, existing, ["method"])


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 0 ELSE n_chars END AS n_chars FROM documents")
def predicate_update(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return sinks.updated(docs, F.col("lang") == "de", n_chars=F.lit(0).cast("long")).select("doc_id", "n_chars")


@query(f"WITH {S.GOLD} SELECT item_id AS question_id, text FROM benchmark WHERE item_id IN (SELECT question_id FROM gold)")
def questions_with_answers(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    return sinks.with_answers(items, gold_answers(spark, sf))


def _learning(spark: SparkSession, sf: str, ratio: int) -> tuple[Corpus, DataFrame, learn.Words, DataFrame]:
    """The index, its articles by field, word vectors, and training pairs with the question's part: 0, 1 or 2."""
    c = Corpus(spark, sf)
    articles = c.fields.select("article_id", "title", "content")
    answers = store(gold_answers(spark, sf).join(articles.select("article_id"), "article_id", "left_semi"), "answers")
    pairs = learn.training_pairs(answers, learn.random_negatives(articles.select("article_id"), answers, ratio))
    parts = evaluate.split(answers.select("question_id").distinct(), (60, 20, 20), "question_id")
    return c, articles, learn.Words(word_vectors(spark, sf, c.vocabulary)), store(pairs.join(parts, "question_id"), "pairs")


@query()
def dan_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The deep-averaging perceptron, fitted on the training questions' pairs, over all questions and articles."""
    c, articles, words, pairs = _learning(spark, sf, 2)
    size = words.matrix.shape[1]
    questions = store(learn.averaged(c.questions, "question_id", words, ["words"]), "question-means")
    means = store(learn.averaged(articles, "article_id", words, ["title", "content"]), "article-means")
    model = learn.fit_averaging(pairs.where("part = 0"), questions, means, size)
    return _learned(learn.score_averaging(model, questions, means, size, TOP))


@query()
def cnn_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The two-tower network, trained with validation, stored, read back, over all questions and articles."""
    c, articles, words, pairs = _learning(spark, sf, 2)
    data = [learn.numbered(learn.pair_texts(pairs.where(F.col("part") == i), c.questions, articles), words) for i in (0, 1)]
    weights, _ = learn.fit_convolution(*data, words.matrix)
    path = place(spark, "cnn-weights")
    learn.save_weights(spark, weights, path)
    return _learned(learn.score_convolution(c.questions, articles, words, learn.load_weights(spark, path), TOP))


def _learned(scores: DataFrame) -> DataFrame:
    found = ranking.ranked(scores, False)
    return found.select("question_id", "article_id", F.col("position").cast("long").alias("position"), F.round("weight", 5).alias("weight"))


@query("SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark INTERSECT SELECT unnest(string_split(text, ' ')) FROM conversations)")
def words_in_common(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda t: table(spark, sf, t).select(F.explode(F.split("text", " ")).alias("word"))
    return words("benchmark").intersect(words("conversations"))


@query("SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) EXCEPT SELECT DISTINCT unnest(string_split(text, ' ')) FROM documents")
def unknown_words(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda t: table(spark, sf, t).select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words("benchmark").join(words("documents"), "word", "left_anti")
