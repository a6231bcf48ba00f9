"""The pipeline against plain Python."""

import hashlib
import re

import pytest
import sentencepiece

import corpus_pipeline
from lodestone.llm import secrets, toxicity

from .cases import LOWER, WORD, documents, texts
from .test_operators import SPM, brute_secrets, brute_stage


def plain_redaction(text):
    out, at = "", 0
    for a, _, b in sorted(brute_secrets(text)):
        if b <= at:
            continue
        if not (a < at <= b):
            out += text[at : max(a, at)] + secrets.MARKER
        at = b
    return out + (text or "")[at:] if at else text


def test_stages_return_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).dtypes == docs.dtypes


def plain_pipeline(rows, lexicon, items):
    """doc_id -> (n_tokens, ids_sha256) of what the five stages keep: one document of each group of texts that one of the
    stage's fingerprints links, and none with a window of 13 benchmark words.
    """
    made = lexicon.automaton()
    kept = [(i, t) for i, t in rows if lexicon.probability(lexicon.evidence(t or "", made)[0]) < 0.5]
    kept = [d for k, (d, g) in enumerate(zip(kept, brute_stage([t for _, t in kept]), strict=True)) if g == k]
    words = lambda t: re.findall(WORD, (t or "").translate(LOWER))
    grams = lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    known = set().union(*(grams(words(t)) for _, t in items)) if items else set()
    kept = [(i, t) for i, t in kept if not grams(words(t)) & known]
    library = sentencepiece.SentencePieceProcessor(model_file=SPM)
    want = {}
    for i, t in kept:
        ids = [*library.encode(plain_redaction(t) or ""), library.eos_id()]
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    return want


def test_run_matches_plain_python(spark, small):
    """`brute_secrets` has the rules only: documents with tokens that the models call random are left out."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = plain_pipeline(rows, lexicon, items)
    random = {r["doc_id"] for r in secrets.report(docs).collect() if "random:" in r["spans"]}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, small).collect()}
    assert set(got) == set(want) and 0 < len(got) < len(rows)
    assert {i: x for i, x in got.items() if i not in random} == {i: x for i, x in want.items() if i not in random}


@pytest.mark.parametrize("empty", [False, True])
def test_run_stands_odd_and_empty_tables(spark, small, tmp_path, empty):
    made = documents(spark, [] if empty else list(enumerate(texts()))).select("doc_id", "text", "lang", "source", "n_chars")
    made.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").where("false" if empty else "true").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    groups = [] if empty else brute_stage(texts())
    assert got == {i for i, g in enumerate(groups) if i == g}
