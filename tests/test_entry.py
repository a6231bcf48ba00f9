import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lodestone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["tokenize_articles", "clean_questions", "positional_index", "tfidf_rank", "cityblock_rank", "window_cosine_rank", "method_report", "redirect_resolution", "category_propagation", "ea_fitness_population", "split_60_20_20", "question_file"]


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in row) for row in df.itertuples(index=False))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, small):
    df = entry.entry(spark)
    assert df.columns == ["question_id", "article_id", "position", "weight"] and df.count() > 0


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, small).toPandas()
    want = con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
