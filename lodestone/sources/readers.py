"""Sources: dumps, JSON lines, dictionaries, stop words, question files, vectors and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import IGNORED_NAMESPACES, clean_question, interlinks, top_sections

ARTICLE_LINES = "title string, section_titles array<string>, section_texts array<string>, interlinks map<string,string>, _corrupt_record string"
SEPARATOR = r"[\t;]"


def read_dump(spark: SparkSession, path: str, min_chars: int = 200, ignored: Sequence[str] = IGNORED_NAMESPACES) -> DataFrame:
    """(title, text) of the pages of a wiki dump with at least min_chars characters of text, but those of namespaces that
    hold no articles; categories are kept.
    """
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, ns long, revision struct<text:string>").load(path)
    rows = pages.select("title", F.col("revision.text").alias("text")).where(F.length("text") >= min_chars)
    return rows.where(~F.split_part("title", F.lit(":"), F.lit(1)).isin(*ignored) | ~F.col("title").contains(":"))


def segmented(pages: DataFrame) -> DataFrame:
    """(title, section_titles, section_texts, interlinks) of pages (title, text), as they go into JSON lines."""
    titles, texts = top_sections(F.col("text"))
    return pages.select("title", titles.alias("section_titles"), texts.alias("section_texts"), interlinks(F.col("text")).alias("interlinks"))


def write_lines(articles: DataFrame, path: str) -> None:
    """(title, section_titles, section_texts, interlinks) as gzipped JSON lines."""
    articles.write.mode("error").option("compression", "gzip").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Articles of JSON lines; lines that can't be parsed are left out."""
    rows = spark.read.schema(ARTICLE_LINES).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & F.col("title").isNotNull()).drop("_corrupt_record")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (changed, base) of lines 'changed;base;...' or with tabs."""
    fields = F.split(F.lower(F.trim("value")), SEPARATOR)
    rows = spark.read.text(path).select(F.trim(F.get(fields, F.lit(0))).alias("changed"), F.trim(F.get(fields, F.lit(1))).alias("base"))
    return rows.where("changed <> '' and base <> ''").distinct()


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, titles): records of a question line and its answers' titles, with a blank line after each.

    A record whose question cleans to nothing is left out.
    """
    records = spark.read.text(path, lineSep="\n\n").select(F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    rows = records.where(F.size("lines") > 0).select(clean_question(F.get("lines", F.lit(0))).alias("question"), F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))).alias("titles"))
    return rows.where("question <> ''")


def write_questions(questions: DataFrame, path: str) -> None:
    """(question, titles) as a question file."""
    line = F.concat_ws("\n", F.concat(F.array("question"), F.col("titles")))
    questions.select(F.concat(line, F.lit("\n")).alias("value")).write.mode("error").text(path)


def inline_questions(spark: SparkSession, questions: str, answers: str) -> DataFrame:
    """(question, title) from 'a;b' and 'x;y', each question with each title."""
    row = spark.createDataFrame([(questions, answers)], "q string, a string")
    return row.select(F.explode(F.split("q", ";")).alias("question"), "a").select(F.trim("question").alias("question"), F.explode(F.split("a", ";")).alias("title")).where("question <> ''")


def form_questions(spark: SparkSession, text: str, title: str = "awk") -> DataFrame:
    """(question, title) of a form's lines, lower-cased and trimmed only."""
    row = spark.createDataFrame([(text,)], "t string")
    lines = row.select(F.explode(F.split("t", "\r?\n")).alias("line"))
    return lines.select(F.trim(F.lower("line")).alias("question"), F.lit(title).alias("title")).where("question <> ''")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of a parquet table of word vectors."""
    return spark.read.parquet(path).select("word", F.col("vec").cast("array<double>").alias("vec"))


def first_lines(df: DataFrame, n: int, by: str) -> DataFrame:
    """The first n rows in an order; all where n is 0."""
    return df.orderBy(by).limit(n) if n > 0 else df


def scraped(pages: DataFrame) -> DataFrame:
    """(page_id, heading, n_links, bold) of pages' HTML."""
    every = lambda p: F.regexp_extract_all("html", F.lit(p), F.lit(1))
    return pages.select("page_id", F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("heading"), F.size(every('href="([^"]*)"')).cast("long").alias("n_links"), F.array_join(every("<b>([^<]*)</b>"), "|").alias("bold"))
