"""Text functions as Column expressions: tokenizing, cleaning, markup, titles, n-grams and names of methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \w and \d are ASCII only, so classes are spelled out.
ARTICLE_TOKEN = r"(\p{Nd}+(?:\.|,)\p{Nd}+|[\p{L}\p{N}_]+|\.)"
QUESTION_TOKEN = r"(\p{Nd}+(?:\.|,)\p{Nd}+|[\p{L}\p{N}_]+)"
# Namespaces whose pages are no articles.
IGNORED_NAMESPACES = ("Wikipedia", "File", "Portal", "Template", "MediaWiki", "User", "Help", "Book", "Draft", "WikiProject", "Special", "Talk")
IGNORED_SECTIONS = ("bibliografia", "linki zewnętrzne", "zobacz też", "przypisy", "uwagi")


def article_tokens(text: Column) -> Column:
    """Lower-case tokens of an article; those of one character go and take no position."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(ARTICLE_TOKEN), F.lit(1)), lambda x: F.length(x) > 1)


def question_tokens(text: Column) -> Column:
    """Tokens of a question as they stand; each takes a position, whatever its length."""
    return F.regexp_extract_all(text, F.lit(QUESTION_TOKEN), F.lit(1))


def clean_question(text: Column) -> Column:
    """Only word characters and single spaces, in lower case."""
    words = F.regexp_replace(text, r"[^\p{L}\p{N}_ ]+", " ")
    return F.trim(F.lower(F.regexp_replace(words, " +", " ")))


def title_of(text: Column) -> Column:
    """The first line."""
    return F.split_part(text, F.lit("\n"), F.lit(1))


def _inside_out(text: Column, opens: str, closes: str, pattern: str, into: str) -> Column:
    """text with a pattern of innermost pairs replaced, in as many passes as pairs are deep in it."""
    marks = F.transform(F.regexp_extract_all(text, F.lit(f"{opens}|{closes}"), F.lit(0)), lambda b: F.when(b.rlike(opens), 1).otherwise(-1))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, b: Column) -> Column:
        now = F.greatest(acc["now"] + b, F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    passes = F.sequence(F.lit(1), F.aggregate(marks, zero, step)["most"] + 2)
    return F.aggregate(passes, text, lambda acc, _: F.regexp_replace(acc, pattern, into))


def strip_markup(text: Column) -> Column:
    """Wiki markup: comments, templates of any depth, references, headings, external links and entities go, tags
    leave their contents, and a link leaves its target's title, also where links stand in its caption; trimmed, in
    lower case.
    """
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = _inside_out(text, r"\{\{", r"\}\}", r"\{\{\{[^{}]*\}\}\}|\{\{[^{}]*\}\}", "")
    text = F.regexp_replace(text, r"(?m)^=+[^=\n]+=+[ ]*$", "")
    text = _inside_out(text, r"\[\[", r"\]\]", r"\[\[([^\[\]|#]*)[^\[\]]*\]\]", "$1")
    for pattern in (r"\[(?:https?|ftp)://[^\]\s]*[^\]]*\]", r"(?:https?|ftp)://[^\s<>\]]+", r"&#?[A-Za-z0-9]+;", r"</?[A-Za-z][^<>]*>", r"'{2,5}"):
        text = F.regexp_replace(text, pattern, "")
    return F.lower(F.trim(text))


def top_sections(text: Column, first: str = "Introduction") -> tuple[Column, Column]:
    """Titles and texts of a page's sections of the top level; what stands before the first heading has the title `first`."""
    heading = r"(?m)^==[ ]*([^=\n](?:[^\n]*[^=\n])?)==[ ]*$"
    titles = F.transform(F.regexp_extract_all(text, F.lit(heading), F.lit(1)), lambda x: F.trim(x))
    return F.concat(F.array(F.lit(first)), titles), F.split(text, heading, -1)


def interlinks(text: Column) -> Column:
    """A page's links as a map of target and anchor (the target itself where there is none), the first of each target."""
    pattern = r"\[\[([^\[\]|]+)(?:\|([^\[\]|]*))?\]\]"
    every = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    names = F.array_distinct(every(1))
    return F.map_from_arrays(names, F.transform(names, lambda t: F.coalesce(F.nullif(F.get(every(2), F.array_position(every(1), t).cast("int") - 1), F.lit("")), t)))


def joined_sections(titles: Column, texts: Column, ignored: Sequence[str] = IGNORED_SECTIONS) -> Column:
    """Section texts, one right after another, without ignored sections."""
    kept = F.filter(F.arrays_zip(titles.alias("title"), texts.alias("text")), lambda s: ~F.lower(F.trim(s["title"])).isin(*ignored))
    return F.array_join(F.transform(kept, lambda s: s["text"]), "")


def word_pairs(base: Column, anchor: Column) -> Column:
    """(base, changed) words of a link's target and its anchor, if all words pair up with equal three-letter beginnings."""
    tokens = lambda c: F.regexp_extract_all(F.lower(F.regexp_replace(c, r"\(.+?\)", "")), F.lit(QUESTION_TOKEN), F.lit(1))
    a, b = tokens(base), tokens(anchor)
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("base"), y.alias("changed")))
    alike = lambda p: p["base"].rlike(r"^\p{L}+$") & p["changed"].rlike(r"^\p{L}+$") & (F.substring(p["base"], 1, 3) == F.substring(p["changed"], 1, 3))
    good = (F.size(a) == F.size(b)) & F.forall(pairs, alike)
    return F.when(good, F.filter(pairs, lambda p: p["base"] != p["changed"])).otherwise(F.array().cast("array<struct<base:string,changed:string>>"))


def adjacent_pairs(words: Column) -> Column:
    """(base, changed) of neighbouring words that differ but begin with the same three letters."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda x, y: F.struct(x.alias("base"), y.alias("changed")))
    alike = lambda p: p["base"].rlike(r"^\p{L}{3,}$") & p["changed"].rlike(r"^\p{L}{3,}$") & (F.substring(p["base"], 1, 3) == F.substring(p["changed"], 1, 3)) & (p["base"] != p["changed"])
    return F.when(F.size(words) > 1, F.filter(pairs, alike)).otherwise(F.array().cast("array<struct<base:string,changed:string>>"))


def title_kind(title: Column, tag: str) -> Column:
    """'category' for titles that start with the tag, else 'article'."""
    return F.when(F.lower(title).startswith(tag), "category").otherwise("article")


def bare_title(title: Column, tag: str) -> Column:
    return F.when(F.lower(title).startswith(tag), F.substr(title, F.lit(len(tag) + 1))).otherwise(title)


def redirect_target(text: Column, link: Column, tag: str) -> Column:
    """The title a redirect leads to: its first link up to '#', else the text without the tag; null if no redirect."""
    rest = F.regexp_replace(text, f"(?i){tag}", "")
    target = F.trim(F.replace(F.split(F.coalesce(link, rest), "#")[0], F.lit("_"), F.lit(" ")))
    return F.when(F.lower(F.ltrim(text)).startswith(tag.lower()), target)


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, space-joined."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def padded(words: Column, width: int, pad: str = "") -> Column:
    """The first `width` words, filled up on the right."""
    head = F.slice(words, 1, width)
    return F.concat(head, F.array_repeat(F.lit(pad), width - F.size(head)))


def unpadded(words: Column, pad: str = "") -> Column:
    """words up to the first padding."""
    at = F.array_position(words, pad)
    return F.when(at > 0, F.slice(words, F.lit(1), (at - 1).cast("int"))).otherwise(words)


def shortened(text: Column, width: int = 50) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 1)), F.lit("…"))).otherwise(text)


def method_name(commit: str, title: Column, ngram: Column, min_idf: Column, n: Column, comparator: Column, power: Column) -> Column:
    """The key under which a scoring run is stored."""
    head = F.format_string("%s, type: tfi, title: %d, ngram: %d, mwiw: %.2f, n: %03d", F.lit(commit), title, ngram, min_idf, n)
    return F.concat(head, F.when(comparator == "tf-idf", F.format_string(", pf: %.2f", power)).otherwise(F.concat(F.lit(", m: "), comparator)))


def method_label(name: Column) -> Column:
    """A short label from a method's name."""
    number = lambda p: F.regexp_extract(name, p, 1)
    kind = (
        F.when(name.contains("type: cnn"), "CNN")
        .when(name.contains("type: dan"), "DAN")
        .when(name.contains("type: ean"), "EA")
        .when(name.contains("type: w2v"), F.concat(F.lit("w2v "), F.coalesce(F.nullif(number(r"topn: (\d+)"), F.lit("")), F.lit("0"))))
        .when(name.contains("cosine"), "cosine")
        .when(name.contains("euclidean"), "euclidean")
        .when(name.contains("cityblock"), "cityblock")
        .otherwise("TF-IDF")
    )
    field = F.when(name.contains("title: 1"), " title").otherwise("")
    grams = F.when(number(r"ngram: (\d+)") == "2", " bigram").otherwise("")
    window = F.coalesce(F.concat(F.lit(" n="), F.nullif(F.regexp_replace(number(r", n: (\d+)"), "^0+", ""), F.lit(""))), F.lit(""))
    return F.concat(kind, field, grams, window)


def smaller_first(name: Column) -> Column:
    """Whether a method's smaller weights are better: distances and vector methods."""
    return name.rlike("w2v|vector|euclidean|cosine|city")


def safe_weight(weight: Column, smaller: Column) -> Column:
    """No weight, or NaN, becomes the worst weight of the method's direction."""
    return F.when(weight.isNull() | F.isnan(weight), F.when(smaller, F.lit(1e5)).otherwise(F.lit(0.0))).otherwise(weight)
