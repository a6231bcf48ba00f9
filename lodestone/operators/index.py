"""From documents and questions to words with positions.

Stop words are a list of stated length, so they are a literal of the plan and taken out inside the scan: no shuffle
stands between a text and its postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

STOP_WORDS, MIN_WORDS = 30, 10


def frequent_words(docs: DataFrame, k: int = STOP_WORDS, tokens: Column | None = None) -> DataFrame:
    """(word, df) of the k words that most documents have; of equals the first in order."""
    tokens = T.article_tokens(F.col("text")) if tokens is None else tokens
    words = docs.select(F.explode(F.array_distinct(tokens)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "word").limit(k)


def stop_words(docs: DataFrame, k: int = STOP_WORDS, tokens: Column | None = None) -> list[str]:
    return sorted(r["word"] for r in frequent_words(docs, k, tokens).collect())


def without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def tokenized(docs: DataFrame) -> DataFrame:
    """(article_id, content, title): tokens of the whole text, and of its title."""
    content, title = T.article_tokens(F.col("text")), T.article_tokens(T.title_of(F.col("text")))
    return docs.select(F.col("doc_id").alias("article_id"), content.alias("content"), title.alias("title"))


def articles(tokens: DataFrame, stop: list[str], min_words: int = MIN_WORDS) -> DataFrame:
    """(article_id, content, title): words of eligible documents without stop words, from tokenized documents.

    Eligibility counts the words of the whole text.
    """
    rows = tokens.select("article_id", without(F.col("content"), stop).alias("content"), without(F.col("title"), stop).alias("title"))
    return rows.where(F.size("content") >= min_words)


def questions(items: DataFrame, stop: list[str], id_col: str = "item_id") -> DataFrame:
    """(question_id, words): cleaned questions without stop words."""
    words = without(T.question_tokens(T.clean_question(F.col("text"))), stop)
    return items.select(F.col(id_col).alias("question_id"), words.alias("words"))


def postings(rows: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, pos, word), positions from 0."""
    return rows.select(key, F.posexplode("words").alias("pos", "word"))


def positional_index(docs: DataFrame, is_title: bool = False) -> DataFrame:
    """(article_id, word, is_title, positions, positions_count), positions from 1 in ascending order."""
    text = T.title_of(F.col("text")) if is_title else F.col("text")
    places = F.transform(T.article_tokens(text), lambda w, i: F.struct(w.alias("word"), (i + 1).alias("pos")))
    rows = docs.select(F.col("doc_id").alias("article_id"), F.array_sort(places).alias("s"))
    # a document is one row: its sorted places are cut where the word changes, and nothing is exchanged
    starts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i)["word"] != F.get("s", i - 1)["word"]))
    rows = rows.where(F.size("s") > 0).select("article_id", "s", starts.alias("starts"))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("s")))
    entry = lambda a, b: F.struct(F.get("s", a)["word"].alias("word"), F.transform(F.slice("s", a + 1, b - a), lambda x: x["pos"]).alias("positions"))
    each = rows.select("article_id", F.explode(F.zip_with("starts", ends, entry)).alias("e"))
    return each.select("article_id", "e.word", F.lit(is_title).alias("is_title"), "e.positions", F.size("e.positions").alias("positions_count"))


def rebuilt_words(index: DataFrame) -> DataFrame:
    """(article_id, words) from a positional index."""
    each = index.select("article_id", F.explode("positions").alias("pos"), "word")
    return each.groupBy("article_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]).alias("words"))


def words_counts(index: DataFrame, articles: DataFrame, stop: list[str]) -> DataFrame:
    """(article_id, words_count): occurrences of other than stop words; articles without any have 0."""
    counted = index.where(~F.col("word").isin(stop)).groupBy("article_id").agg(F.sum("positions_count").alias("n"))
    return articles.select("article_id").join(counted, "article_id", "left").select("article_id", F.coalesce("n", F.lit(0)).cast("long").alias("words_count"))


def word_forms(docs: DataFrame) -> DataFrame:
    """Distinct (changed, base) mined from neighbouring words."""
    pairs = docs.select(F.explode(T.adjacent_pairs(T.article_tokens(F.col("text")))).alias("p"))
    return pairs.select(F.col("p.changed").alias("changed"), F.col("p.base").alias("base")).distinct()


def base_form_map(forms: DataFrame) -> DataFrame:
    """(changed, base): of several base forms the greatest."""
    return forms.groupBy("changed").agg(F.max("base").alias("base"))


def in_base_form(postings: DataFrame, forms: DataFrame) -> DataFrame:
    """postings with each word in its base form, or as it is; one step, no closure."""
    known = base_form_map(forms).withColumnRenamed("changed", "word")
    return postings.join(known, "word", "left").withColumn("word", F.coalesce("base", "word")).drop("base")


def extended_stop_words(stop: DataFrame, forms: DataFrame) -> DataFrame:
    """Stop words and their changed forms, distinct."""
    changed = forms.join(stop, forms["base"] == stop["word"], "left_semi").select(F.col("changed").alias("word"))
    return stop.select("word").union(changed).distinct()


def forms_of(words: DataFrame, forms: DataFrame) -> DataFrame:
    """All words that share a base form with the given ones: the bases' changed forms and the bases, distinct (word, form)."""
    bases = words.join(forms, words["word"] == forms["changed"], "inner").select("word", "base")
    changed = bases.join(forms, "base").select("word", F.col("changed").alias("form"))
    return changed.union(bases.select("word", F.col("base").alias("form"))).distinct()


def adjacent(rows: DataFrame, key: str, pos: str = "pos", word: str = "word") -> DataFrame:
    """(key..., pos, first, second) of words at positions next to each other."""
    w = Window.partitionBy(*key.split(",")).orderBy(pos)
    following = rows.withColumn("__p", F.lead(pos).over(w)).withColumn("second", F.lead(word).over(w))
    return following.where(F.col("__p") == F.col(pos) + 1).withColumnRenamed(word, "first").drop("__p")
