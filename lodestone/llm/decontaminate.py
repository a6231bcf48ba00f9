"""Benchmark decontamination over a stored positional inverted index of the training documents.

Words are runs of letters, digits and non-ASCII characters, with A-Z in lower case.  The index is dealt by documents: a
row holds the postings of a block of whole documents, that is, the block's terms, and for each term its positions in
ascending order, all as binary columns.  It knows nothing of any benchmark, and may be searched again and again.

A search turns benchmark items into windows of consecutive words.  In each block, windows some word of which the block
lacks go at once; the others start from the postings of their rarest terms (by their number in the whole corpus), which
are intersected after each list is shifted by the term's offset in the window, until every word has agreed.  Nothing is
shuffled but one total a term.  Items are searched in groups of bounded size, one scan of the index each, so that what
is sent to executors stays bounded however large the benchmark is.

Within a block two words are the same term if two independent 64-bit polynomial fingerprints and their lengths agree;
terms of the benchmark are compared with the block's terms byte by byte.

Defined results: null or wordless documents have no words, no hits and are not contaminated; null or wordless items
have no windows; repeated rows are kept, each with its own result; items that share an item_id are one item with all
their windows; an item with a null item_id hits words but has no name, so it isn't counted; empty tables give no rows,
or rows without hits.

A filtering stage takes out every document with a whole window, however long the document (`keep_clean`); the share of
hit words decides only about items too short for a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, only, store

WINDOW, SHARE = 13, 20
#: Bytes of text in a block of the index; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20
#: Bytes of benchmark text that one scan of the index looks for.
SCAN_BYTES = 16 << 20
#: Bytes of index rows, of some MB each, that are written, and later read, together.
GROUP_BYTES = 16 << 20
#: Contaminated documents whose keys are sent to every task; of more, documents are exchanged by key, texts included.
SENT_KEYS = 500_000
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
WORD = np.array([x >= 128 or chr(x).isalnum() for x in range(256)])
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
INDEX = "block long, doc_ids binary, text_hashes binary, known binary, bounds binary, terms binary, term_ends binary, hashes binary, list_ends binary, positions binary"


def words_of(text: str | None) -> list[bytes]:
    data = (text or "").encode().translate(LOWER)
    raw = np.frombuffer(data, np.uint8)
    starts, ends = _bounds(WORD[raw])
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """A polynomial hash of each word.  Words are hashed by their bytes in turn, all words of a length or more at once."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at = starts[order]
    left = length[order]
    h = np.zeros(len(starts), np.uint64)
    most = int(left[0]) if len(left) else 0
    # how many words have more than k bytes
    alive = len(left) - np.searchsorted(left[::-1], np.arange(min(most, 64)), side="right")
    for k in range(min(most, 64)):
        n = alive[k]
        h[:n] = h[:n] * base + raw[at[:n] + k] + np.uint64(1)
    for i in range(int(np.count_nonzero(left > 64))):  # few and long
        rest = raw[at[i] + 64 : at[i] + left[i]]
        x = int(h[i])
        for part in (rest[j : j + 8].tobytes() for j in range(0, len(rest), 8)):
            x = (x * int(base) + int.from_bytes(part, "little") + len(part)) & 0xFFFFFFFFFFFFFFFF
        h[i] = x
    out = np.empty_like(h)
    out[order] = _mixed(h)
    return out


def _index_row(doc_ids: list, text_hashes: list[int], texts: list[bytes]) -> dict[str, bytes]:
    data = b" ".join(texts).translate(LOWER)
    raw = np.frombuffer(data, np.uint8)
    starts, ends = _bounds(WORD[raw])
    tops = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, tops)  # words before each document's end
    first, second = (word_hashes(raw, starts, ends, b) for b in BASES)
    length = ends - starts
    order = np.argsort(first, kind="stable")
    f, s, n = first[order], second[order], length[order]
    change = f[1:] != f[:-1]
    if np.any(~change & ((s[1:] != s[:-1]) | (n[1:] != n[:-1]))):  # two words with one hash: order by all that is known
        order = np.lexsort((np.arange(len(first)), length, second, first))
        f, s, n = first[order], second[order], length[order]
        change = (f[1:] != f[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1])
    heads = np.flatnonzero(np.r_[True, change]) if len(order) else np.empty(0, np.int64)
    sample = order[heads]
    terms = [data[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)]
    # words of two documents never stand in a row: a gap after each document
    gap = np.repeat(np.arange(len(texts)), np.diff(bounds, prepend=0)).astype(np.int64) * WINDOW_GAP
    position = np.arange(len(starts), dtype=np.int64) + gap
    return {
        "doc_ids": np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        "text_hashes": np.array(text_hashes, "<i8").tobytes(),
        "known": np.array([x is not None for x in doc_ids], np.uint8).tobytes(),
        "bounds": bounds.astype("<i8").tobytes(),
        "terms": b"".join(terms),
        "term_ends": np.cumsum([len(t) for t in terms]).astype("<i8").tobytes(),
        "hashes": f[heads].astype("<u8").tobytes(),
        "list_ends": np.r_[heads[1:], len(order)].astype("<i8").tobytes() if len(heads) else b"",
        "positions": position[order].astype("<u4").tobytes(),
    }


#: Positions left free after a document; the longest window that is looked for.
WINDOW_GAP = 64


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of docs, written to the shared folder."""
    bounded_batches(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("decontaminate")
        ids: list = []
        hashes: list[int] = []
        texts: list[bytes] = []
        held = 0

        number = TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            row = _index_row(ids, hashes, texts)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in row.values())], names=["block", *row])

        for batch in batches:
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                if ids and held + len(text) > BLOCK_BYTES:
                    yield close()
                    ids, hashes, texts, held, number = [], [], [], 0, number + 1
                ids.append(doc_id)
                hashes.append(text_hash)
                texts.append(text)
                held += len(text)
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return store(rows.mapInArrow(blocks, INDEX), "postings", group=GROUP_BYTES)


class Block:
    """One row of the index."""

    def __init__(self, row: dict[str, bytes]) -> None:
        self.number = row["block"]
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.text_hashes = np.frombuffer(row["text_hashes"], "<i8")
        self.known = np.frombuffer(row["known"], np.uint8)
        self.bounds = np.frombuffer(row["bounds"], "<i8")
        self.terms = row["terms"]
        self.term_ends = np.frombuffer(row["term_ends"], "<i8")
        self.hashes = np.frombuffer(row["hashes"], "<u8")
        self.list_ends = np.frombuffer(row["list_ends"], "<i8")
        self.positions = np.frombuffer(row.get("positions") or b"", "<u4")

    def find(self, terms: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The number of each term here, -1 where the block lacks it."""
        out = np.full(len(terms), -1, np.int64)
        if not len(self.hashes):
            return out
        at = np.searchsorted(self.hashes, hashes)
        for i in np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes).tolist():
            j = int(at[i])
            while j < len(self.hashes) and self.hashes[j] == hashes[i]:
                if self.terms[int(self.term_ends[j - 1]) if j else 0 : int(self.term_ends[j])] == terms[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def postings(self, term: int) -> np.ndarray:
        return self.positions[int(self.list_ends[term - 1]) if term else 0 : int(self.list_ends[term])].astype(np.int64)


class Plan:
    """Windows of a bounded group of items, over one list of terms."""

    def __init__(self, items: list[tuple], size: int) -> None:
        number: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            words = [number.setdefault(w, len(number)) for w in words_of(text)]
            for i in range(len(words) - min(size, len(words)) + 1 if words else 0):
                windows.setdefault(tuple(words[i : i + size]), set()).update([] if item_id is None else [str(item_id)])
        self.terms = list(number)
        raw = np.frombuffer(b"".join(self.terms), np.uint8)
        ends = np.cumsum([len(t) for t in self.terms]).astype(np.int64)
        starts = np.r_[0, ends[:-1]].astype(np.int64) if len(ends) else ends
        self.hashes = word_hashes(raw, starts, ends, BASES[0])
        self.windows, self.items, self.size = list(windows), list(windows.values()), size
        self.flat = np.array([t for w in self.windows for t in w], np.int64)
        self.begins = np.cumsum([0, *(len(w) for w in self.windows)])[:-1].astype(np.int64)
        self.order: list[list[int]] = []

    def rank(self, frequency: dict[int, int]) -> None:
        """Offsets in each window from the term that is rarest in the corpus."""
        self.order = [sorted(range(len(w)), key=lambda i, w=w: (frequency.get(w[i], 0), i)) for w in self.windows]

    def phrases(self, block: Block) -> Iterator[tuple[int, np.ndarray]]:
        """Windows that occur in the block, with the positions at which they start."""
        if not self.windows:
            return
        here = block.find(self.terms, self.hashes)
        whole = np.minimum.reduceat(here[self.flat], self.begins) >= 0
        for w in np.flatnonzero(whole).tolist():
            words, found = self.windows[w], None
            for i in self.order[w]:
                at = block.postings(int(here[words[i]])) - i
                found = at if found is None else found[_among(at, found)]
                if not len(found):
                    break
            if len(found):
                yield w, found

    def near(self, block: Block, slop: int) -> Iterator[tuple[int, np.ndarray]]:
        """Windows all of whose words stand, in any order, within `slop` words of an occurrence of the rarest."""
        here = block.find(self.terms, self.hashes) if self.windows else []
        for w, words in enumerate(self.windows):
            order = [int(here[words[i]]) for i in self.order[w]]
            if min(order) < 0:
                continue
            found = block.postings(order[0])
            for term in dict.fromkeys(order[1:]):
                at = block.postings(term)
                to = np.searchsorted(at, found - slop)
                found = found[(to < len(at)) & (at[np.minimum(to, len(at) - 1)] <= found + slop)]
                if not len(found):
                    break
            if len(found):
                yield w, found


def _among(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, wanted)
    return (at < len(sorted_values)) & (sorted_values[np.minimum(at, len(sorted_values) - 1)] == wanted)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row)


def _plans(index: DataFrame, items: DataFrame, size: int, scan_bytes: int) -> Iterator[Plan]:
    """Items in groups of at most scan_bytes of text each (or one item), ranked by the corpus's counts of their terms."""
    groups = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // max(1, scan_bytes // 2)))
    for g in range(groups):
        part = items if groups == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        plan = Plan([tuple(r) for r in part.select("item_id", "text").toLocalIterator()], size)

        def counts(batches: Iterator[pa.RecordBatch], plan: Plan = plan) -> Iterator[pa.RecordBatch]:
            only("decontaminate")
            total = np.zeros(len(plan.terms), np.int64)
            for block in _blocks(batches):
                here = block.find(plan.terms, plan.hashes)
                have = here >= 0
                total[have] += np.diff(block.list_ends, prepend=0)[here[have]]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

        light = index.select("block", "doc_ids", "text_hashes", "known", "bounds", "terms", "term_ends", "hashes", "list_ends")
        totals = light.mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        plan.rank({r["term"]: r["n"] for r in totals.collect()} if plan.windows else {})
        yield plan


def joined_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words, those that meet or overlap made one."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def _search(index: DataFrame, plan: Plan) -> DataFrame:
    """A row for each document of the index: its number in the index, words, the spans that are hit, and the items."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("decontaminate")
        for block in _blocks(batches):
            docs = len(block.doc_ids)
            before = np.r_[0, block.bounds[:-1]].astype(np.int64)
            words = block.bounds - before
            origin = before + WINDOW_GAP * np.arange(docs)
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            wholes = np.zeros(docs, np.int64)
            for w, starts in plan.phrases(block):
                of = np.searchsorted(origin, starts, side="right") - 1
                # documents without words share an origin's place with none of the positions
                for doc, at in zip(of.tolist(), (starts - origin[of]).tolist(), strict=True):
                    spans.setdefault(doc, []).append((at, at + len(plan.windows[w])))
                    items.setdefault(doc, set()).update(plan.items[w])
                    wholes[doc] += len(plan.windows[w]) == plan.size
            ranges, names, hits = [], [], np.zeros(docs, np.int64)
            for doc in range(docs):
                merged = joined_spans(spans.get(doc, ()))
                hits[doc] = sum(b - a for a, b in merged)
                ranges.append([x for ab in merged for x in ab])
                names.append(sorted(items.get(doc, ())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.number] * docs, pa.int64()), pa.array(np.arange(docs)), pa.array(block.doc_ids, pa.int64(), mask=block.known == 0), pa.array(block.text_hashes, pa.int64()), pa.array(words), pa.array(hits), pa.array(wholes), pa.array(ranges, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))],
                names=["block", "at", "doc_id", "text_hash", "n_words", "n_hit", "n_whole", "spans", "items"],
            )

    return index.mapInArrow(found, "block long, at long, doc_id long, text_hash long, n_words long, n_hit long, n_whole long, spans array<long>, items array<string>")


def search(index: DataFrame, benchmark: DataFrame, size: int = WINDOW, item_col: str = "item_id", text_col: str = "text", scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_whole (occurrences of windows of `size` words), spans (word ranges, flat:
    start, end, ...) and items of every document of the index."""
    if size > WINDOW_GAP:
        raise ValueError(f"windows have at most {WINDOW_GAP} words")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    parts = [_search(index, plan) for plan in _plans(index, items, size, scan_bytes)]
    return parts[0].drop("block", "at") if len(parts) == 1 else _merged(parts)


def _merged(parts: list[DataFrame]) -> DataFrame:
    """The union of several scans' hits, document by document of the index."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    key = ["block", "at", "doc_id", "text_hash", "n_words"]
    grouped = rows.groupBy(*key).agg(
        F.sum("n_whole").alias("n_whole"), F.flatten(F.collect_list("spans")).alias("flat"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [joined_spans(zip(x[::2], x[1::2], strict=True)) for x in batch.column("flat").to_pylist()]
            names = ["doc_id", "text_hash", "n_words", "n_whole", "items"]
            hits, spans = pa.array([sum(b - a for a, b in m) for m in made], pa.int64()), pa.array([[x for ab in m for x in ab] for m in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), hits, spans], names=[*names, "n_hit", "spans"])

    done = grouped.mapInArrow(joined, "doc_id long, text_hash long, n_words long, n_whole long, items array<string>, n_hit long, spans array<long>")
    return done.select("doc_id", "text_hash", "n_words", "n_hit", "n_whole", "spans", "items")


def proximity(index: DataFrame, benchmark: DataFrame, slop: int, size: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, near): items a window of which has all its words within `slop` words of its rarest, anywhere."""
    if slop >= WINDOW_GAP:
        raise ValueError(f"slop is under {WINDOW_GAP} words")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    parts = []
    for plan in _plans(index, items, size, SCAN_BYTES):

        def found(batches: Iterator[pa.RecordBatch], plan: Plan = plan) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                origin = np.r_[0, block.bounds[:-1]].astype(np.int64) + WINDOW_GAP * np.arange(len(block.doc_ids))
                rows = {(int(d), item) for w, at in plan.near(block, slop) for d in np.unique(np.searchsorted(origin, at, side="right") - 1) for item in plan.items[w]}
                ids = [int(block.doc_ids[d]) if block.known[d] else None for d, _ in sorted(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([i for _, i in sorted(rows)], pa.string())], names=["doc_id", "item_id"])

        parts.append(index.mapInArrow(found, "doc_id long, item_id string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items of every row of docs."""
    found = search(build_index(docs), benchmark, size)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
        "items",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of docs, all columns, without those that hold a window of `size` benchmark words.

    One passage is enough, in a text of any length: a long document with a passage leaks it as a short one does.  Items
    under `size` words can stand in clean texts by chance; where a text holds only such, 1 / share of its words or more
    must be theirs.
    """
    found = search(build_index(docs), benchmark, size)
    bad = found.where((F.col("n_whole") > 0) | ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))
    of, print_ = fresh(docs.columns, "of", "print")
    gone = store(bad.select(F.col("doc_id").alias(of), F.col("text_hash").alias(print_)).distinct(), "contaminated")
    # a small key is sent to the texts, whatever the session's threshold: an exchange of all texts takes an executor's memory
    gone = F.broadcast(gone) if gone.count() <= SENT_KEYS else gone
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[of]) & (F.xxhash64(docs["text"]) == gone[print_]), "left_anti")
