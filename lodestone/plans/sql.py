"""Pieces of SQL that several oracles share."""

TOKENS = r"list_filter(regexp_extract_all(lower({0}), '(\p{{Nd}}+(?:\.|,)\p{{Nd}}+|[\p{{L}}\p{{N}}_]+|\.)', 1), lambda x: length(x) > 1)"
CLEAN = r"trim(lower(regexp_replace(regexp_replace({0}, '[^\p{{L}}\p{{N}}_ ]+', ' ', 'g'), ' +', ' ', 'g')))"
WORDS = r"regexp_extract_all({0}, '(\p{{Nd}}+(?:\.|,)\p{{Nd}}+|[\p{{L}}\p{{N}}_]+)', 1)"

DOC_TOKENS = TOKENS.format("text")
ITEM_TOKENS = WORDS.format(CLEAN.format("text"))

#: raw(article_id, word, p): tokens with positions from 1.
RAW = f"raw AS (SELECT doc_id AS article_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM (SELECT doc_id, {DOC_TOKENS} AS w FROM documents))"
#: stop(word): the 30 words that most documents have.
STOP = "stop AS (SELECT word FROM (SELECT word, count(DISTINCT article_id) AS df FROM raw GROUP BY word ORDER BY df DESC, word LIMIT 30))"
#: post(article_id, word, pos), n(n): postings of eligible articles without stop words.
POST = """kept AS (SELECT article_id, word, row_number() OVER (PARTITION BY article_id ORDER BY p) - 1 AS pos FROM raw WHERE word NOT IN (SELECT word FROM stop)),
elig AS (SELECT article_id FROM kept GROUP BY article_id HAVING count(*) >= 10),
post AS (SELECT kept.* FROM kept SEMI JOIN elig USING (article_id)),
n AS (SELECT count(*) AS n FROM elig)"""
#: qpost(question_id, word, pos): questions without stop words.
QUESTIONS = f"""qraw AS (SELECT item_id AS question_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM (SELECT item_id, {ITEM_TOKENS} AS w FROM benchmark)),
qpost AS (SELECT question_id, word, row_number() OVER (PARTITION BY question_id ORDER BY p) - 1 AS pos FROM qraw WHERE word NOT IN (SELECT word FROM stop)),
qn AS (SELECT question_id, count(*) AS n FROM qpost GROUP BY question_id)"""
#: tc(article_id, word, c), idf(word, df, idf), qw(question_id, word, qw), norms(question_id, n2, n1).
WEIGHTS = """tc AS (SELECT article_id, word, count(*) AS c FROM post GROUP BY ALL),
idf AS (SELECT word, count(*) AS df, ln(any_value(n.n)::DOUBLE / count(*)) AS idf FROM tc, n GROUP BY word),
qw AS (SELECT q.question_id, q.word, count(*)::DOUBLE / any_value(qn.n) * any_value(idf.idf) AS qw FROM qpost q JOIN qn USING (question_id) JOIN idf USING (word) WHERE idf.idf > {min_idf} GROUP BY ALL),
norms AS (SELECT question_id, sum(qw * qw) AS n2, sum(abs(qw)) AS n1 FROM qw GROUP BY question_id)"""
#: scored columns of a comparator from s, k, dot, v2, d1 and norms.
COMPARE = {
    "tf-idf": "s * pow(k, 3)",
    "cosine": "CASE WHEN v2 > 1e-12 AND n2 > 0 THEN 1 - dot / sqrt(n2 * v2) END",
    "euclidean": "sqrt(greatest(n2 - 2 * dot + v2, 0))",
    "cityblock": "n1 + d1",
}
SUMS = """sums AS (SELECT question_id, article_id, sum(w) AS s, count(*) AS k, coalesce(sum(w * coalesce(qw, 0)), 0) AS dot,
coalesce(sum(CASE WHEN qw IS NOT NULL THEN w * w END), 0) AS v2, coalesce(sum(CASE WHEN qw IS NOT NULL THEN abs(qw - w) - abs(qw) END), 0) AS d1
FROM weighted LEFT JOIN qw USING (question_id, word) GROUP BY question_id, article_id)"""


def base(*more: str, min_idf: float = 0.0) -> str:
    return "WITH " + ",\n".join([RAW, STOP, POST, QUESTIONS, WEIGHTS.format(min_idf=min_idf), *more])


def rank_of(comparator: str, k: int = 3, scored: str = "sums LEFT JOIN norms USING (question_id)") -> str:
    order = "DESC" if comparator == "tf-idf" else "ASC"
    return f"""scores AS (SELECT question_id, article_id, {COMPARE[comparator]} AS weight FROM {scored}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(weight, 6) {order}, article_id) AS position FROM scores WHERE weight IS NOT NULL)
SELECT question_id, article_id, position, round(weight, 5) + 0.0 AS weight FROM ranked WHERE position <= {k}"""


WEIGHTED = """matched AS (SELECT q.question_id, tc.article_id, tc.word, tc.c, idf.idf FROM (SELECT DISTINCT question_id, word FROM qpost) q JOIN tc USING (word) JOIN idf USING (word)),
weighted AS (SELECT question_id, article_id, word, c::DOUBLE / sum(c) OVER (PARTITION BY question_id, article_id) * idf AS w FROM matched)"""


def document_rank(comparator: str, k: int = 3, min_idf: float = 0.0) -> str:
    return base(WEIGHTED, SUMS, rank_of(comparator, k), min_idf=min_idf)


def window_sums(n: int) -> str:
    """sums(question_id, article_id, pos, s, k, dot, v2, d1) of every window that ends at a match, straight from the definition."""
    return f"""hits AS (SELECT q.question_id, p.article_id, p.word, p.pos FROM (SELECT DISTINCT question_id, word FROM qpost) q JOIN post p USING (word)),
inside AS (SELECT question_id, article_id, pos, unnest(list(word) OVER (PARTITION BY question_id, article_id ORDER BY pos RANGE BETWEEN {n} PRECEDING AND CURRENT ROW)) AS word FROM hits),
counted AS (SELECT question_id, article_id, pos, word, count(*) AS c FROM inside GROUP BY ALL),
weighted AS (SELECT question_id, article_id, pos, word, c::DOUBLE / {n} * idf.idf AS w FROM counted JOIN idf USING (word)),
sums AS (SELECT question_id, article_id, pos, sum(w) AS s, count(*) AS k, coalesce(sum(w * coalesce(qw, 0)), 0) AS dot,
coalesce(sum(CASE WHEN qw IS NOT NULL THEN w * w END), 0) AS v2, coalesce(sum(CASE WHEN qw IS NOT NULL THEN abs(qw - w) - abs(qw) END), 0) AS d1
FROM weighted LEFT JOIN qw USING (question_id, word) GROUP BY question_id, article_id, pos)"""


def window_best(comparator: str, n: int) -> str:
    sign = "-" if comparator == "tf-idf" else ""
    pick = "max" if comparator == "tf-idf" else "min"
    return f"""{window_sums(n)},
each AS (SELECT question_id, article_id, pos, {COMPARE[comparator]} AS weight FROM sums LEFT JOIN norms USING (question_id)),
best AS (SELECT question_id, article_id, {pick}(weight) AS weight, arg_min(pos, (round({sign}weight, 9), pos)) AS pos FROM each WHERE weight IS NOT NULL GROUP BY question_id, article_id)"""


def window_rank(comparator: str, n: int, k: int = 3) -> str:
    order = "DESC" if comparator == "tf-idf" else "ASC"
    return base(window_best(comparator, n), f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(weight, 6) {order}, article_id) AS position FROM best)
SELECT question_id, article_id, position, round(weight, 5) + 0.0 AS weight FROM ranked WHERE position <= {k}""")


#: Gold answers: documents that hold an item's text.
GOLD = "gold AS (SELECT DISTINCT b.item_id AS question_id, d.doc_id AS article_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
#: Rates from events: a question is a user, an article an event, a method an event's type.
RATES = "rates AS (SELECT user_id AS question_id, event_id % 50 AS article_id, event_type AS method, avg(value) AS weight FROM events GROUP BY ALL)"
