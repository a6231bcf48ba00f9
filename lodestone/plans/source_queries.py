"""Sources and streams, read back from what is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as I
from ..operators import ranking, tfidf
from ..sources import readers
from ..storage import place
from ..streaming import questions as stream
from . import sql as S
from .rank_queries import TOP, Corpus
from .registry import query, table
from .text_queries import PLAIN, plain_words


@query(f"SELECT split_part(text, chr(10), 1) AS title, CAST(len({S.DOC_TOKENS}) AS BIGINT) AS n_words FROM (SELECT text FROM documents)")
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Articles through gzipped JSON lines, a section for each line after the title."""
    lines = F.split("text", "\n")
    docs = table(spark, sf, "documents").select(
        lines[0].alias("title"),
        F.transform(lines, lambda x, i: i.cast("string")).alias("section_titles"),
        F.transform(lines, lambda x, i: F.when(i < F.size(lines) - 1, F.concat(x, F.lit("\n"))).otherwise(x)).alias("section_texts"),
        F.create_map(F.lit("Link"), F.lit("anchor")).alias("interlinks"),
    )
    path = place(spark, "lines")
    readers.write_lines(docs, path)
    back = readers.read_lines(spark, path)
    return back.select("title", F.size(T.article_tokens(T.joined_sections(F.col("section_titles"), F.col("section_texts")))).cast("long").alias("n_words"))


@query(f"SELECT {S.CLEAN.format('text')} AS question, CAST(1 + item_id % 3 AS BIGINT) AS n_titles FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark)")
def question_file(spark: SparkSession, sf: str) -> DataFrame:
    """Questions through a question file."""
    items = table(spark, sf, "benchmark").select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("question"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("item_id") % 3), lambda i: F.concat(F.lit("Title "), i)).alias("titles"))
    path = place(spark, "questions")
    readers.write_questions(items, path)
    return readers.read_questions(spark, path).select("question", F.size("titles").cast("long").alias("n_titles"))


@query("SELECT DISTINCT lower(source) AS changed, lower(lang) AS base FROM documents")
def dictionary_file(spark: SparkSession, sf: str) -> DataFrame:
    """Word forms through a delimited dictionary, with both separators."""
    line = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("\t", "source", "lang", F.lit("more"))).otherwise(F.concat_ws(";", F.upper("source"), "lang"))
    path = place(spark, "dictionary")
    table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    return readers.read_dictionary(spark, path)


@query("SELECT split_part(url, '/', 3) AS title, count(*) AS pages FROM pages WHERE length(html) >= 500 GROUP BY 1")
def xml_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Pages through an XML dump; pages under 500 characters are left out."""
    pages = table(spark, sf, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("title"), F.struct(F.col("html").alias("text")).alias("revision"))
    path = place(spark, "dump")
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return readers.read_dump(spark, path, 500).groupBy("title").agg(F.count("*").alias("pages"))


@query(f"""SELECT CASE doc_id % 7 WHEN 0 THEN 'Category:Doc ' ELSE 'Doc: ' END || doc_id AS title, a AS base, a || 'a' AS changed FROM ({PLAIN}) WHERE doc_id % 7 <> 1 AND doc_id % 3 = 0""")
def word_pairs_links(spark: SparkSession, sf: str) -> DataFrame:
    """Word pairs from the anchors of links, from an XML dump through segmented JSON lines."""
    i = F.col("doc_id")
    title = F.concat(F.when(i % 7 == 0, "Category:Doc ").when(i % 7 == 1, "File:Doc ").otherwise("Doc: "), i)
    # of three anchors the first has another form, the second is the target, the third doesn't begin like it
    anchor = F.when(i % 3 == 0, F.concat("a", F.lit("a (x y) "), "b")).when(i % 3 == 1, F.concat_ws(" ", "a", "b")).otherwise(F.concat(F.lit("q_"), "a", F.lit(" "), "b"))
    text = F.concat(F.lit("Intro.\n== Historia ==\nSee [["), "a", F.lit(" "), "b", F.lit("|"), anchor, F.lit("]] and [[Other]]."))
    dump, lines = place(spark, "dump"), place(spark, "lines")
    plain_words(spark, sf).select(title.alias("title"), F.struct(text.alias("text")).alias("revision")).write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(dump)
    readers.write_lines(readers.segmented(readers.read_dump(spark, dump, 5)), lines)
    links = readers.read_lines(spark, lines).where(F.size("section_titles") == 2).select("title", F.explode("interlinks").alias("target", "anchor"))
    return links.select("title", F.explode(T.word_pairs(F.col("target"), F.col("anchor"))).alias("p")).select("title", "p.base", "p.changed")


@query("SELECT item_id, left(text, 30) AS head FROM benchmark ORDER BY item_id LIMIT 10")
def first_lines(spark: SparkSession, sf: str) -> DataFrame:
    return readers.first_lines(table(spark, sf, "benchmark"), 10, "item_id").select("item_id", F.left("text", F.lit(30)).alias("head"))


@query(S.document_rank("tf-idf"))
def stream_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The TF-IDF ranking again, with the questions as a stream of four files, two a batch."""
    c = Corpus(spark, sf)

    def rank(batch: DataFrame) -> DataFrame:
        return ranking.top(tfidf.score_documents(batch, c.articles, c.n, frequencies=c.frequencies), TOP, False)

    source = place(spark, "incoming")
    table(spark, sf, "benchmark").repartition(4, "item_id").write.parquet(source)
    incoming = stream.question_stream(spark, source, "item_id long, text string", files_a_batch=2)
    out = place(spark, "rankings")
    words = I.questions(incoming, c.stop)
    stream.rank_stream(words, rank, "tf-idf", out, place(spark, "stream")).awaitTermination()
    found = stream.rankings(spark, out)
    return found.select("question_id", "article_id", "position", (F.round("weight", 5) + 0.0).alias("weight"))


