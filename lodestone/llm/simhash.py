"""Near-duplicate groups by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits; two texts are linked where at most DISTANCE = 4 bits differ.  Such a pair differs in at most
two bits of one 32-bit half.  So each distinct fingerprint enters, for each half, the Hamming ball of radius one around
that half into a table (66 rows); linked pairs meet at a key half-way between them, and candidates are verified on all
64 bits.  Of a task's pairs only a forest comes out: as many links as join the same fingerprints, fewer than the table has
rows.  A key that holds more than CROWD fingerprints makes no pairs: its members are looked up exactly by the ball of
radius two around the whole fingerprint, where everything that meets at a key is within four bits, so that a star of
links, linear in the members, says the same as all pairs.  Nothing is dropped.

A pipeline's stage takes shingles of STAGE_SHINGLE words and STAGE_PRINTS fingerprints of each text.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; texts under SHINGLE words
are one shingle; repeated rows are rows like any other; a null doc_id never names a component if another id is in it;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, only, partitions, scope, store, with_unique
from .components import components

SHINGLE, SEED, DISTANCE, CROWD = 4, 42, 4, 64
#: Words of a shingle and fingerprints of a text in a filtering stage.
STAGE_SHINGLE, STAGE_PRINTS = 5, 4
#: Bytes of texts that are looked at together.
CHUNK = 1 << 20
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
HALF = 0xFFFFFFFF


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every text in turn, and how many each text has."""
    joined = b" ".join(texts).translate(LOWER) + b" "
    raw = np.frombuffer(joined, np.uint8)
    space = SPACE[raw]
    word_end = np.empty_like(space)
    word_end[0] = False
    word_end[1:] = space[1:] & ~space[:-1]
    keep = ~space | word_end
    flat = np.where(space, np.uint8(32), raw)[keep]
    ends = np.flatnonzero(word_end[keep])  # the space after each word
    starts = np.empty_like(ends)
    if len(ends):
        starts[0], starts[1:] = 0, ends[:-1] + 1
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    words_to = np.searchsorted(np.flatnonzero(word_end), text_ends, side="right")
    words = np.diff(words_to, prepend=0)
    counts = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    total = int(counts.sum())
    of = np.repeat(np.arange(len(texts)), counts)
    first = np.repeat(words_to - words, counts) + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.minimum(first + size, words_to[of]) - 1
    text, digest = flat.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, total)
    return hashes, counts


def fingerprints(texts: list[bytes], size: int = SHINGLE, prints: int = 1) -> np.ndarray:
    """(texts, prints) 64-bit fingerprints, as signed integers: a bit is 1 if over half the shingles' hashes have it.

    The first is that of the hashes themselves; each other one is that of the hashes mixed by a number of its own.
    """
    out = np.zeros((len(texts), prints), np.int64)
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) <= CHUNK):
            held += len(texts[stop])
            stop += 1
        hashes, counts = shingle_hashes(texts[at:stop], size)
        some = np.flatnonzero(counts)
        for j in range(prints if len(some) else 0):
            out[at + some, j] = _majority(mixed(hashes, j), counts[some], (np.cumsum(counts) - counts)[some])
        at = stop
    return out


def mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    if not number:
        return hashes
    x = hashes ^ np.uint64(number * 0x9E3779B97F4A7C15 & 2**64 - 1)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _majority(hashes: np.ndarray, counts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(counts), 64), np.int64)
    if len(counts) == 1:
        for i in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums[0] += bits.sum(axis=0, dtype=np.int64)
    else:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[:] = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view("<i8").reshape(-1)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, prints: int = 1) -> DataFrame:
    """(doc_id, text_hash, fp, fp1, ...) of every row, written to the shared folder."""
    bounded_batches(docs.sparkSession)
    names = ["fp", *(f"fp{j}" for j in range(1, prints))]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("simhash")
        for batch in batches:
            made = fingerprints([x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()], size, prints)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(made[:, j]) for j in range(prints))], names=["doc_id", "text_hash", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return store(rows.mapInArrow(marked, "doc_id long, text_hash long, " + ", ".join(f"{x} long" for x in names)), "fingerprints")


def _arrow(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows sorted by their first column, as arrays that cut no run of equal keys of up to `most` rows.

    Of a longer run up to `most` + 1 rows are carried on, so that each part of it shows that it is long.
    """
    key, val = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        val = np.concatenate([val, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if len(key) - cut > most:
            yield key, val
            key, val = key[-most - 1 :], val[-most - 1 :]
        else:
            yield key[:cut], val[:cut]
            key, val = key[cut:], val[cut:]
    if len(key):
        yield key, val


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly what the pairs join: each number but the least of its component to that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(live := np.flatnonzero(root[x] != root[y])):
        one, other = root[x[live]], root[y[live]]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while np.any((up := root[root]) != root):
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """distinct (fp long): links (a, b) that join exactly those fingerprints that chains of close pairs join."""
    spark = distinct.sparkSession
    bounded_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    n = partitions(spark)

    def balls() -> DataFrame:
        masks = [0, *(1 << i for i in range(32))]
        both = F.explode(F.array(*[F.lit(m) for m in masks]).cast("array<long>")).alias("mask")
        low, high = F.col("fp").bitwiseAND(F.lit(HALF)), F.shiftrightunsigned("fp", 32)
        halves = distinct.select("fp", F.explode(F.array(low, high.bitwiseOR(F.lit(1 << 32)))).alias("half"))
        return halves.select(F.col("half"), "fp", both).select(F.col("half").bitwiseXOR(F.col("mask")).alias("key"), "fp")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links that join what the verified pairs of small keys join, fewer than the fingerprints that are in them, however
        many pairs these make; a member of a crowded key comes out linked to itself."""
        only("simhash")
        for key, fp in _runs(batches, CROWD):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(key)])
            size = np.repeat(sizes, sizes)
            crowd = np.unique(fp[size > CROWD])
            none = np.empty(0, np.int64)
            a, b = [none], [none]
            live = np.flatnonzero((size > 1) & (size <= CROWD))
            k, f = key[live], fp[live]
            for d in range(1, min(CROWD, len(live))):
                same = np.flatnonzero(k[d:] == k[:-d])
                if not len(same):
                    break
                x, y = f[same], f[same + d]
                near = np.bitwise_count((x ^ y).view(np.uint64)) <= DISTANCE
                a.append(x[near])
                b.append(y[near])
            x, y = _forest(np.concatenate(a), np.concatenate(b))
            if len(x) or len(crowd):
                yield _arrow(a=np.concatenate([crowd, x]), b=np.concatenate([crowd, y]))

    dealt = balls().repartition(n, "key").sortWithinPartitions("key")
    found = store(dealt.mapInArrow(met, "a long, b long").distinct(), "candidates")
    crowded = found.where("a = b").select(F.col("a").alias("fp"))

    flips = [[], *([i] for i in range(64)), *(list(c) for c in combinations(range(64), 2))]
    signed = [int(np.array(sum(1 << i for i in f), np.uint64).view(np.int64)) for f in flips]

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("simhash")
        masks = np.array(signed, np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 100):
                part = fp[i : i + 100]
                yield _arrow(key=(part[:, None] ^ masks[None, :]).reshape(-1), fp=np.repeat(part, len(masks)))

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All that meet at a key are linked to one of them, after all 64 bits are compared; of a run that batches cut,
        a link carries on."""
        only("simhash")
        for key, fp in _runs(batches, 1):
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            head = np.repeat(fp[starts], np.diff(np.r_[starts, len(key)]))
            other = (head != fp) & (np.bitwise_count((head ^ fp).view(np.uint64)) <= DISTANCE)
            x, y = _forest(head[other], fp[other])
            if len(x):
                yield _arrow(a=x, b=y)

    wide = crowded.repartition(n, "fp").mapInArrow(around, "key long, fp long").repartition(n, "key").sortWithinPartitions("key", "fp")
    return found.where("a <> b").unionByName(wide.mapInArrow(stars, "a long, b long"))


def rooted(marked: DataFrame, prints: int = 1) -> DataFrame:
    """(fp, root) of every distinct fingerprint of `marked`; those that links join have the same root.

    With further fingerprints, texts whose further ones are linked are linked as well: of the texts that a component of
    further fingerprints holds, each is linked to the one with the least fingerprint, so links stay linear in the texts.
    """
    with scope(marked.sparkSession, "roots"):
        distinct = store(marked.select("fp").distinct(), "distinct")
        links = fingerprint_links(distinct)
        for j in range(1, prints):
            name = f"fp{j}"
            both = store(marked.select("fp", name).distinct(), "both")
            others = rooted(both.select(F.col(name).alias("fp")))
            held = store(with_unique(both.withColumnRenamed("fp", "of").withColumnRenamed(name, "fp"), others, "fp", partitions(marked.sparkSession)).select("of", "root").distinct(), "held")
            least = store(held.groupBy("root").agg(F.min("of").alias("least")), "least-prints")
            met = with_unique(held, least, "root", partitions(marked.sparkSession))
            links = links.unionByName(met.where("of <> least").select(F.col("of").alias("a"), F.col("least").alias("b")))
        roots = components(links)
        return store(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links reach, for every row.

    However many copies a text has, or texts a component, their rows are not exchanged by what they share: keys that hold
    many rows get the few rows they meet sent to them.
    """
    n = partitions(docs.sparkSession)
    with scope(docs.sparkSession, "fingerprints", "labels"):
        marked = with_fingerprints(docs, id_col, text_col, size).drop("text_hash")
        roots = rooted(marked)
        each = store(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp"), "least-ids")
        least = store(each.groupBy("root").agg(F.min("least").alias("component_id")), "components")
        labels = store(with_unique(roots, least, "root", n).select("fp", "component_id"), "labels")
    return with_unique(marked, labels, "fp", n).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, size: int = SHINGLE, prints: int = 1) -> DataFrame:
    """One row of each group of near copies, all columns: the least doc_id (nulls last), then the least hash of the text.

    Of rows that agree in both one stays.  Two texts are linked where one of `prints` independent fingerprints differs in
    at most DISTANCE bits: the more there are, the less near copies are missed (README has figures by overlap).
    """
    with scope(docs.sparkSession, "winners"):
        marked = with_fingerprints(docs, size=size, prints=prints)
        return first_of(docs, marked, rooted(marked, prints))


def first_of(docs: DataFrame, marked: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of docs that come first in their groups: marked (doc_id, text_hash, fp), roots (fp, root)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("hash"))
    each = marked.groupBy("fp").agg(F.min(order).alias("w")).join(roots, "fp")
    none, of, print_, copy = fresh(docs.columns, "none", "of", "print", "copy")
    first = each.groupBy("root").agg(F.min("w").alias("w"))
    winners = store(first.select(F.col("w.none").alias(none), F.col("w.id").alias(of), F.col("w.hash").alias(print_)), "winners")
    keyed = docs.withColumns({none: F.col("doc_id").isNull(), of: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), print_: F.xxhash64("text")})
    key = [of, print_, none]
    once = Window.partitionBy(*key).orderBy(*key)
    return keyed.join(winners, key, "left_semi").withColumn(copy, F.row_number().over(once)).where(F.col(copy) == 1).select(*docs.columns)
