"""Text and index queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as I
from .registry import query, table
from .sql import CLEAN, DOC_TOKENS, ITEM_TOKENS, RAW, STOP, TOKENS, WORDS


@query(f"SELECT doc_id AS article_id, unnest(w) AS word, CAST(generate_subscripts(w, 1) AS BIGINT) AS pos FROM (SELECT doc_id, {DOC_TOKENS} AS w FROM documents)")
def tokenize_articles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), F.posexplode(T.article_tokens(F.col("text"))).alias("p", "word")).select("article_id", "word", (F.col("p") + 1).cast("long").alias("pos"))


@query(f"SELECT item_id AS question_id, unnest(w) AS word, CAST(generate_subscripts(w, 1) AS BIGINT) AS pos FROM (SELECT item_id, {WORDS.format('lower(text)')} AS w FROM benchmark)")
def tokenize_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.posexplode(T.question_tokens(F.lower("text"))).alias("p", "word")).select("question_id", "word", (F.col("p") + 1).cast("long").alias("pos"))


@query(f"SELECT conv_id, turn, {CLEAN.format('text')} AS cleaned FROM conversations WHERE role = 'user'")
def clean_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.clean_question(F.col("text")).alias("cleaned"))


@query(f"WITH {RAW} SELECT article_id, word, array_to_string(list(p ORDER BY p), ',') AS positions, count(*) AS positions_count FROM raw GROUP BY article_id, word")
def positional_index(spark: SparkSession, sf: str) -> DataFrame:
    found = I.positional_index(table(spark, sf, "documents"))
    return found.select("article_id", "word", F.array_join("positions", ",").alias("positions"), F.col("positions_count").cast("long").alias("positions_count"))


@query(f"SELECT doc_id AS article_id, word, count(*) AS positions_count FROM (SELECT doc_id, unnest({TOKENS.format(chr(40) + 'split_part(text, chr(10), 1)' + chr(41))}) AS word FROM documents) GROUP BY ALL")
def title_index(spark: SparkSession, sf: str) -> DataFrame:
    return I.positional_index(table(spark, sf, "documents"), is_title=True).select("article_id", "word", F.col("positions_count").cast("long").alias("positions_count"))


@query(f"SELECT doc_id AS article_id, array_to_string(w, ' ') AS words FROM (SELECT doc_id, {DOC_TOKENS} AS w FROM documents) WHERE len(w) > 0")
def rebuild_words(spark: SparkSession, sf: str) -> DataFrame:
    return I.rebuilt_words(I.positional_index(table(spark, sf, "documents"))).select("article_id", F.array_join("words", " ").alias("words"))


@query(f"WITH {RAW}, {STOP} SELECT d.doc_id AS article_id, count(r.word) AS words_count FROM documents d LEFT JOIN (SELECT * FROM raw WHERE word NOT IN (SELECT word FROM stop)) r ON r.article_id = d.doc_id GROUP BY d.doc_id")
def words_count_no_stop(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return I.words_counts(I.positional_index(docs), docs.select(F.col("doc_id").alias("article_id")), I.stop_words(docs))


@query(f"WITH {RAW}, {STOP} SELECT word, word IN (SELECT word FROM stop) AS is_stop_word FROM (SELECT DISTINCT word FROM raw)")
def stop_word_flag(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    words = docs.select(F.explode(F.array_distinct(T.article_tokens(F.col("text")))).alias("word")).distinct()
    return words.select("word", F.col("word").isin(I.stop_words(docs)).alias("is_stop_word"))


FORMS = r"""forms AS (SELECT DISTINCT b AS base, c AS changed FROM (SELECT word AS b, lead(word) OVER (PARTITION BY article_id ORDER BY p) AS c FROM raw)
WHERE b <> c AND b[1:3] = c[1:3] AND regexp_full_match(b, '\p{L}{3,}') AND regexp_full_match(c, '\p{L}{3,}'))"""


@query(f"WITH {RAW}, {STOP}, {FORMS} SELECT word FROM stop UNION SELECT changed FROM forms WHERE base IN (SELECT word FROM stop)")
def extended_stop_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return I.extended_stop_words(I.frequent_words(docs), I.word_forms(docs))


@query(f"SELECT item_id AS question_id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) AS ngram FROM (SELECT item_id, {ITEM_TOKENS} AS w FROM benchmark) WHERE len(w) >= 2")
def ngrams2(spark: SparkSession, sf: str) -> DataFrame:
    words = T.question_tokens(T.clean_question(F.col("text")))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.explode(T.ngrams(words, 2)).alias("ngram"))


@query(f"WITH {RAW}, {FORMS} SELECT base, changed FROM forms")
def word_pairs_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return I.word_forms(table(spark, sf, "documents")).select("base", "changed")


@query(f"WITH {RAW}, {FORMS} SELECT changed, max(base) AS base FROM forms GROUP BY changed")
def base_form_map(spark: SparkSession, sf: str) -> DataFrame:
    return I.base_form_map(I.word_forms(table(spark, sf, "documents")))


@query(f"WITH {RAW}, {FORMS}, m AS (SELECT changed, max(base) AS base FROM forms GROUP BY changed) SELECT article_id, coalesce(m.base, word) AS word, count(*) AS n FROM raw LEFT JOIN m ON m.changed = raw.word GROUP BY ALL")
def words_in_base_form(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("article_id"), F.explode(T.article_tokens(F.col("text"))).alias("word"))
    return I.in_base_form(rows, I.word_forms(docs)).groupBy("article_id", "word").agg(F.count("*").alias("n"))


@query(f"""WITH {RAW}, {FORMS}, q AS (SELECT DISTINCT unnest({ITEM_TOKENS}) AS word FROM benchmark),
b AS (SELECT q.word, f.base FROM q JOIN forms f ON f.changed = q.word) SELECT DISTINCT b.word, f.changed AS form FROM b JOIN forms f USING (base) UNION SELECT word, base FROM b""")
def forms_expansion(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "benchmark").select(F.explode(T.question_tokens(T.clean_question(F.col("text")))).alias("word")).distinct()
    return I.forms_of(words, I.word_forms(table(spark, sf, "documents")))


#: Titles of the test tables: even documents' sources are categories.
TITLE = "CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'Kategoria:' || source ELSE split_part(text, chr(10), 1) END"


@query(f"SELECT doc_id, CASE WHEN starts_with(lower(t), 'kategoria:') THEN 'category' ELSE 'article' END AS kind, CASE WHEN starts_with(lower(t), 'kategoria:') THEN substr(t, 11) ELSE t END AS title FROM (SELECT doc_id, {TITLE} AS t FROM documents)")
def title_routing(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.col("source").isin("src1", "src2", "src3"), F.concat(F.lit("Kategoria:"), "source")).otherwise(T.title_of(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", T.title_kind(F.col("t"), "kategoria:").alias("kind"), T.bare_title(F.col("t"), "kategoria:").alias("title"))


@query("""SELECT doc_id, CASE WHEN starts_with(lower(x), '#patrz') THEN trim(replace(split_part(coalesce(link, regexp_replace(x, '(?i)#patrz', '', 'g')), '#', 1), '_', ' ')) END AS target
FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN '#PATRZ ' || source || '_' || lang ELSE text END AS x, CASE WHEN source = 'src4' THEN 'Some_page#Part' END AS link FROM documents)""")
def redirect_parse(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("lang") == "de", F.concat(F.lit("#PATRZ "), "source", F.lit("_"), "lang")).otherwise(F.col("text"))
    link = F.when(F.col("source") == "src4", "Some_page#Part")
    return table(spark, sf, "documents").select("doc_id", T.redirect_target(x, link, "#patrz").alias("target"))


#: Two plain words of a document, of three letters or more.
PLAIN = "SELECT doc_id, coalesce(w[1], 'none') AS a, coalesce(w[2], 'none') AS b FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents)"


def plain_words(spark: SparkSession, sf: str) -> DataFrame:
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.get(w, 0), F.lit("none")).alias("a"), F.coalesce(F.get(w, 1), F.lit("none")).alias("b"))


#: Markup of every kind around the words A and B.
MARKUP = (
    "  <!-- no {{ B -->A{{T|x={{U|B|{{{1}}}}}}} Link [[A|B]][http://x.org/B out] '''bold'''\n== Head ==\n"
    "B&nbsp;<ref name=x/> [[File:B.png|thumb|a [[A|caption]] of <b>A</b>]]<i> end</i>https://y.org/A "
)


@query(f"SELECT doc_id, a || ' link ' || a || ' bold' || chr(10) || b || ' file:' || b || '.png end' AS stripped FROM ({PLAIN})")
def strip_markup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' words in markup of every kind, and what must be left of it; a heading leaves an empty line."""
    text = F.regexp_replace(F.regexp_replace(F.lit(MARKUP), F.lit(r"\bA\b"), F.col("a")), F.lit(r"\bB\b"), F.col("b"))
    return plain_words(spark, sf).select("doc_id", F.regexp_replace(T.strip_markup(text), "\n+", "\n").alias("stripped"))


@query()
def strip_markup_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The operator on unaltered pages; the query above takes brackets and quotes out first, as its SQL does."""
    return table(spark, sf, "pages").select("page_id", T.strip_markup(F.col("html")).alias("stripped"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 3 <> 1), '') AS content FROM documents")
def sections_concat(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.split("text", "\n")
    titles = F.transform(lines, lambda x, i: F.when(i % 3 == 0, " Bibliografia ").otherwise("Historia"))
    return table(spark, sf, "documents").select("doc_id", T.joined_sections(titles, lines).alias("content"))


@query(f"SELECT item_id AS question_id, array_to_string(list_concat(w[:20], list_transform(range(greatest(0, 20 - len(w))), lambda x: '-')), ' ') AS padded, array_to_string(w[:20], ' ') AS words FROM (SELECT item_id, {ITEM_TOKENS} AS w FROM benchmark)")
def padded_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), T.padded(T.question_tokens(T.clean_question(F.col("text"))), 20, "-").alias("p"))
    return rows.select("question_id", F.array_join("p", " ").alias("padded"), F.array_join(T.unpadded(F.col("p"), "-"), " ").alias("words"))


@query("SELECT doc_id, CASE WHEN length(t) > 50 THEN left(t, 49) || '…' ELSE t END AS title FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents)")
def short_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.shortened(T.title_of(F.col("text"))).alias("title"))


@query(r"SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS heading, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS BIGINT) AS n_links, array_to_string(regexp_extract_all(html, '<b>([^<]*)</b>', 1), '|') AS bold FROM pages".replace('\\"', '"'))
def html_scrape(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.readers import scraped

    return scraped(table(spark, sf, "pages"))
