"""Sharding by histogram sort, with DataFrame operations only.

Rows are ordered by a 64-bit key, and shards are spans of that order with near equal bytes.  Splitters are found by
counting: each round counts, in all partitions at once, the exact bytes of every bin of the ranges that still hold a
splitter, and takes the bin in which each splitter's target falls as its next, finer range.  It ends when every
splitter is within the tolerance, or is a key that can't be refined.  Then every row knows its shard by comparing its
key with the splitters, and rows are exchanged once.

The key is a hash of doc_id and text, so copies of a text spread evenly; rows equal in both share a key and stay
together.  Nothing but bin totals (BINS for each splitter at most) and the splitters come to the driver.  Slots are
numbered inside small bins of the key, each of which is one group, and shifted by the bins' counts before them.

Null text has no bytes: its row counts OVERHEAD.  An empty table gives no rows; with fewer rows than shards some shards
are empty; other columns of docs are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, partitions, store

SHARDS, OVERHEAD = 40, 16
#: Key bits that one round refines; share of a shard's bytes by which a splitter may miss its target.
BITS, TOLERANCE = 12, 0.0005
#: Rows of a bin within which slots are numbered, at most about.
SLOT_ROWS = 20_000
TOP = 1 << 63


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and key (unsigned order, kept signed by flipping the top bit), in the shared folder."""
    text = F.col(text_col)
    return store(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(F.col(id_col).cast("long"), text).alias("key"),
        ),
        "keys",
    )


def _bins(rows: DataFrame, shift: int, within: list[int] | None, width: int) -> list[tuple[int, int]]:
    """(bin, bytes) in key order: bins are the key without its low `shift` bits, inside coarser bins if any are given."""
    number = F.shiftright("key", shift)
    if within is not None:
        rows = rows.where(F.shiftright("key", shift + width).isin(within))
    made = rows.groupBy(number.alias("bin")).agg(F.sum("size").alias("bytes"))
    return sorted((r["bin"], r["bytes"]) for r in made.collect())


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, bits: int = BITS) -> list[int]:
    """Keys at which shards 1, 2, ... begin (the first key of each), by refining probes."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * i // shards for i in range(1, shards)]
    allowed = max(1, int(tolerance * total / shards))
    low = {i: (-TOP, 0) for i in range(len(targets))}  # the range's first key, and the exact bytes before it
    found: dict[int, int] = {}
    shift, within = 64, None
    while low and shift:
        width = min(bits, shift)
        shift -= width
        bins = _bins(rows, shift, within, width)
        by_range: dict[int, list[tuple[int, int]]] = {}
        for b, n in bins:
            by_range.setdefault((b << shift) >> (shift + width) if shift + width < 64 else 0, []).append((b, n))
        following: dict[int, tuple[int, int]] = {}
        for i, (first, before) in low.items():
            at = before
            for b, n in by_range.get(first >> (shift + width) if shift + width < 64 else 0, []):
                begins, after = b << shift, at + n
                if abs(at - targets[i]) <= allowed:
                    found[i] = begins
                elif abs(after - targets[i]) <= allowed or not shift and after > targets[i]:
                    nearer = after - targets[i] < targets[i] - at
                    found[i] = begins + (1 << shift) if nearer or abs(after - targets[i]) <= allowed else begins
                elif after > targets[i]:
                    following[i] = (begins, at)
                else:
                    at = after
                    continue
                break
            else:
                found[i] = TOP - 1
        low = following
        within = sorted({first >> shift for first, _ in low.values()})
    out = [min(found[i], TOP - 1) for i in range(len(targets))]
    return [max(out[: i + 1]) for i in range(len(out))]


def _shard(key: Column, at: list[int], low: int = 0) -> Column:
    """How many splitters are at or below the key, by halving."""
    if not at:
        return F.lit(low)
    mid = len(at) // 2
    return F.when(key < F.lit(at[mid]), _shard(key, at[:mid], low)).otherwise(_shard(key, at[mid + 1 :], low + mid + 1))


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is not `key`) of every row."""
    rows = keyed(docs, id_col, text_col)
    at = splitters(rows, shards, tolerance)
    count = rows.count()
    fine = max(0, min(40, (max(1, count // SLOT_ROWS) - 1).bit_length() + 1))
    placed = rows.withColumn("shard", _shard(F.col("key"), at).cast("int")).withColumn("bin", F.shiftright("key", 64 - fine) if fine else F.lit(0).cast("long"))
    by_shard = Window.partitionBy("shard").orderBy("bin")
    counts = placed.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bin", (F.sum("n").over(by_shard) - F.col("n")).alias("before"))
    inside = Window.partitionBy("shard", "bin").orderBy("key", "doc_id", "text_crc32")
    numbered = placed.withColumn("number", F.row_number().over(inside) - 1)
    return numbered.join(before, ["shard", "bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, under path/shard=N in the order of their keys, exchanged once; read back with their shard.

    Where docs have a column `shard` of their own, the new one is `shard_`.

    Rows go by ranges of (shard, key), so a shard is written by as many tasks as its rows need.
    """
    at = splitters(keyed(docs, id_col, text_col), shards, tolerance)
    number, key = fresh(docs.columns, "shard", "key")
    placed = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)))
    placed = placed.withColumn(number, _shard(F.col(key), at).cast("int"))
    ranged = placed.repartitionByRange(max(shards, partitions(docs.sparkSession)), number, key).sortWithinPartitions(number, key, id_col)
    ranged.drop(key).write.partitionBy(number).parquet(path)
    return docs.sparkSession.read.parquet(path)
