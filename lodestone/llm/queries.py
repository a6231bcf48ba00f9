"""The queries opN_<name> and their SQL: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import report

    return report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import shard

    return shard(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_column

    return encode_column(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features, to_media

    return media_features(to_media(table(spark, sf_dir, "documents")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_chats

    text = "</s>[INST] ok [/INST]"
    given = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_chats(format_chats(rows.unionByName(given)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
GRAMS_SQL = "list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))"

OP2_SQL = f"""
WITH items AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, unnest({GRAMS_SQL}) AS g FROM items),
docs AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
grams AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest({GRAMS_SQL}) AS g FROM docs, (SELECT DISTINCT n FROM items) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP10_SQL = r"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t) AS said,
coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, t) FILTER (r = 'assistant'), '') AS loss,
bool_or(regexp_matches(r || chr(10) || t, '<\|(chat:[0-9]+|turn|text|end)\|>')) AS escaped,
sum(length(r) + length(t) + 23)::BIGINT AS plain,
sum(length(r || ' ' || t) - length(replace(r || ' ' || t, '\', '')) + (length(r || ' ' || t) - length(replace(r || ' ' || t, '<|', ''))) // 2)::BIGINT AS more
FROM given GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
10 + plain + CASE WHEN escaped THEN more ELSE 0 END AS formatted_chars, true AS identical FROM whole
"""


def oracle_sql() -> dict[str, str]:
    """The others need hashes, tokenizers or models that SQL doesn't have; tests hold them against brute force."""
    return {"op2_decontamination": OP2_SQL, "op10_chat": OP10_SQL}
