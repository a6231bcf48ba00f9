import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import index as I


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


SAMPLE = "Łódź ma 3,14 i 2.5 km². A b."


def test_article_tokens(spark):
    assert one(spark, T.article_tokens(F.col("t")), t=SAMPLE) == ["łódź", "ma", "3,14", "2.5", "km²"]


def test_question_tokens(spark):
    assert one(spark, T.question_tokens(F.lower("t")), t=SAMPLE) == ["łódź", "ma", "3,14", "i", "2.5", "km²", "a", "b"]
    assert one(spark, T.question_tokens(T.clean_question(F.col("t"))), t=SAMPLE) == ["łódź", "ma", "3", "14", "i", "2", "5", "km²", "a", "b"]


@given(st.lists(st.text(alphabet="aąbź1 .,;?²-", max_size=20), min_size=1, max_size=20))
@settings(max_examples=5, deadline=None)
def test_tokens_agree_with_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["x"] for r in df.select(T.article_tokens(F.col("t")).alias("x")).collect()]
    assert got == [[w for w in re.findall(r"(\d+(?:\.|,)\d+|\w+|\.)", t.lower()) if len(w) > 1] for t in texts]


def test_word_pairs(spark):
    cases = [("Kot (zwierzę)", "Koty", [("kot", "koty")]), ("Wielki dom", "Wielkiego domu", [("wielki", "wielkiego"), ("dom", "domu")]), ("Pies", "Kot", []), ("Rok 1990", "Roku 1990", []), ("Stary dom", "Domy", [])]
    for a, b, want in cases:
        assert [tuple(p) for p in one(spark, T.word_pairs(F.col("a"), F.col("b")), a=a, b=b)] == want


def test_markup(spark):
    text = "== Nagłówek ==\n'''Kot''' to [[ssak|zwierzę]] {{szablon|a={{b}}}}<!-- x --> [http://a.b opis] <b>domowy</b>&nbsp;."
    assert one(spark, T.strip_markup(F.col("t")), t=text).split() == ["kot", "to", "ssak", "domowy."]


def test_deep_templates(spark):
    deep = "kot " + "{{a|b=" * 7 + "{{{x}}}" + "}}" * 7 + " pies"
    assert one(spark, T.strip_markup(F.col("t")), t=deep).split() == ["kot", "pies"]


def test_markup_query_of_whole_pages(spark, tmp_path):
    from lodestone.plans import text_queries

    html = "<p>a</p>\n== B ==\n[[Kot|kota]] [http://a.b c] {{a|{{b|{{c}}}}}}" + "'" * 3 + "Pies"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert text_queries.strip_markup_whole(spark, str(tmp_path)).first()["stripped"].split() == ["a", "kot", "pies"]


def test_redirects_and_titles(spark):
    target = lambda t, l: one(spark, T.redirect_target(F.col("t"), F.col("l"), "#patrz"), t=t, l=l)
    assert target("#PATRZ [[x]]", "Nowa_strona#Część") == "Nowa strona"
    assert target("#Patrz Inna", None) == "Inna"
    assert target("Zwykły tekst", "Link") is None
    assert one(spark, T.title_kind(F.col("t"), "kategoria:"), t="Kategoria:Ssaki") == "category"
    assert one(spark, T.bare_title(F.col("t"), "kategoria:"), t="Kategoria:Ssaki") == "Ssaki"


def test_arrays(spark):
    words = F.split("t", " ")
    assert one(spark, T.ngrams(words, 2), t="a b c") == ["a b", "b c"] and one(spark, T.ngrams(words, 4), t="a b c") == []
    assert one(spark, T.padded(words, 4, "-"), t="a b") == ["a", "b", "-", "-"] and one(spark, T.padded(words, 1, "-"), t="a b") == ["a"]
    assert one(spark, T.unpadded(words, "-"), t="a b - -") == ["a", "b"]
    assert one(spark, T.shortened(F.col("t"), 5), t="abcdefg") == "abcd…"


def test_sections(spark):
    df = spark.createDataFrame([(["Wstęp", " Bibliografia ", "Dalej"], ["a ", "b ", "c"])], "n array<string>, t array<string>")
    assert df.select(T.joined_sections(F.col("n"), F.col("t")).alias("x")).first()["x"] == "a c"


def test_method_names(spark):
    assert one(spark, T.method_label(F.col("t")), t="abc, type: tfi, title: 1, ngram: 2, mwiw: 0.00, n: 015, m: cosine") == "cosine title bigram n=15"
    df = spark.createDataFrame([(float("nan"), True), (None, False), (2.0, True)], "w double, s boolean")
    assert [r[0] for r in df.select(T.safe_weight(F.col("w"), F.col("s"))).collect()] == [1e5, 0.0, 2.0]


def test_index_round_trip(spark):
    docs = spark.createDataFrame([(1, "kot pies kot. dom"), (2, "a b c"), (3, None)], "doc_id long, text string")
    index = I.positional_index(docs)
    got = {(r["article_id"], r["word"]): r["positions"] for r in index.collect()}
    assert got == {(1, "kot"): [1, 3], (1, "pies"): [2], (1, "dom"): [4]}
    assert [r["words"] for r in I.rebuilt_words(index).collect()] == [["kot", "pies", "kot", "dom"]]
    counts = I.words_counts(index, docs.select(F.col("doc_id").alias("article_id")), ["kot"])
    assert {r["article_id"]: r["words_count"] for r in counts.collect()} == {1: 2, 2: 0, 3: 0}


def test_base_forms(spark):
    forms = spark.createDataFrame([("mam", "mama"), ("mam", "mieć"), ("koty", "kot")], "changed string, base string")
    words = spark.createDataFrame([(1, 0, "mam"), (1, 1, "koty"), (1, 2, "inne")], "article_id long, pos int, word string")
    assert [r["word"] for r in I.in_base_form(words, forms).orderBy("pos").collect()] == ["mieć", "kot", "inne"]
    stop = spark.createDataFrame([("kot",)], "word string")
    assert {r["word"] for r in I.extended_stop_words(stop, forms).collect()} == {"kot", "koty"}
