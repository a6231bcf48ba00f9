from pyspark.sql import functions as F

from lodestone.sources import readers, sinks
from lodestone.streaming import questions as stream


def test_question_file(spark, tmp_path):
    path = tmp_path / "q.txt"
    path.write_text("Kto, gdzie?\nTytuł A\nTytuł B\n\n!!!\nX\n\nSamo pytanie\n")
    got = {r["question"]: r["titles"] for r in readers.read_questions(spark, str(path)).collect()}
    assert got == {"kto gdzie": ["Tytuł A", "Tytuł B"], "samo pytanie": []}


def test_json_lines_skip_what_is_broken(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"title": "A", "section_titles": ["x"], "section_texts": ["y"], "interlinks": {"K": "k"}}\nnot json\n')
    got = readers.read_lines(spark, str(path)).collect()
    assert len(got) == 1 and got[0]["interlinks"] == {"K": "k"}


def test_dictionary_and_stop_words(spark, tmp_path):
    (tmp_path / "d").write_text("Koty;kot;x\nmam\tmieć\nKoty;kot\nsam\n")
    assert {tuple(r) for r in readers.read_dictionary(spark, str(tmp_path / "d")).collect()} == {("koty", "kot"), ("mam", "mieć")}
    (tmp_path / "s").write_text(" I \noraz\n\n")
    assert {r["word"] for r in readers.read_stop_words(spark, str(tmp_path / "s")).collect()} == {"i", "oraz"}


def test_inline_and_form(spark):
    assert sorted(tuple(r) for r in readers.inline_questions(spark, "a;b", "x;y").collect()) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    assert [tuple(r) for r in readers.form_questions(spark, "Raz\r\n\r\n Dwa ").collect()] == [("raz", "awk"), ("dwa", "awk")]


def test_append_absent_and_update(spark, tmp_path):
    old = spark.createDataFrame([("a", 1)], "k string, v long")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], "k string, v long")
    path = str(tmp_path / "t")
    old.write.parquet(path)
    sinks.append_absent(new, spark.read.parquet(path), ["k"], path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    assert [r["v"] for r in sinks.updated(old, F.col("k") == "a", v=F.lit(9).cast("long")).collect()] == [9]


def test_save_ranking_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 1.0)], "question_id long, article_id long, weight double")
    for method in ("m", "n", "m"):
        sinks.save_ranking(rows, rows, method, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/rates")).count() == 2


def test_stream_leaves_solved_questions_out(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "question_id long, words array<string>"
    seen = []

    def rank(batch):
        seen.append(sorted(r["question_id"] for r in batch.collect()))
        return batch.select("question_id", F.lit(1).cast("long").alias("article_id"), F.lit(1).alias("position"), F.lit(0.5).alias("weight"))

    for ids in ((1, 2), (2, 3)):
        spark.createDataFrame([(i, ["a"]) for i in ids], schema).coalesce(1).write.mode("append").parquet(source)
        stream.rank_stream(stream.question_stream(spark, source, schema), rank, "m", out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["question_id"] for r in stream.rankings(spark, out).collect()) == [1, 2, 3]
    assert seen == [[1, 2], [3]]
