"""Every registered query on the smallest tables: the contract's columns, and a row for each document or conversation."""

import pytest

from lodestone.llm import queries

COLUMNS = {
    "op1": "doc_id start n_tokens ids_crc32",
    "op2": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op3": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op4": "doc_id held_out score predicted",
    "op5": "doc_id fingerprint component_id",
    "op6": "doc_id size text_crc32 law shard slot grown_shard",
    "op7": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op9": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op10": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
}


@pytest.mark.parametrize("name", queries.queries())
def test_registered_query(spark, small, name):
    found = queries.queries()[name](spark, small)
    wanted = COLUMNS[name.split("_")[0]].split()
    assert set(wanted) <= set(found.columns)
    table, key = ("conversations", "conv_id") if name.startswith("op10") else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{small}/{table}.parquet").select(key).distinct().collect()} | ({-7} if key == "conv_id" else set())
    got = [r[0] for r in found.select(key).collect()]
    assert sorted(got) == sorted(ids)
