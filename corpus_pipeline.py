"""The corpus pipeline: STAGES in order over `documents`, each on what the stage before it kept.

All stages but the last return the columns of documents.  Toxic documents go; of each group of near copies the document
with the least id stays; documents with a passage of the benchmark go; secrets are replaced in the texts of the rest
(n_chars follows); the last stage encodes what is left.  SQL can't express these stages; tests hold them against
brute force.  Null and empty texts are no words, toxic to nobody, copies of each other and pieces of nothing; repeated rows
are copies; an empty table of documents gives no rows, and empty labels or an empty benchmark take nothing out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common, decontaminate, pieces, secrets, simhash, toxicity
from lodestone.llm.queries import vocabulary

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon doesn't call toxic."""
    lexicon = toxicity.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, lexicon)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, by several fingerprints of five-word shingles."""
    return simhash.keep_first(docs, simhash.STAGE_SHINGLE, simhash.STAGE_PRINTS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't repeat the benchmark."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every document."""
    return pieces.encode_column(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", one_of_near_copies),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives; tables of the stages before it, and what they stored, are removed."""
    docs = common.table(spark, sf_dir, "documents")
    with common.scope(spark, STAGES[-1][0]):
        for name, stage in STAGES:
            docs = common.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
