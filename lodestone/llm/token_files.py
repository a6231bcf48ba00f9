"""Token-ID output: ids in the fewest bits that hold the vocabulary, in blocks that can be read at random.

A token file is one binary value; a table of them (shard, segment, ...) is written by Spark's own committer, so a
lost executor or a repeated task leaves no torn or doubled file.  Layout, little-endian:

    header   magic, bits, ids a block, documents, ids, ids of the shard before this file
    doc ids  int64 each, and a byte each that is 0 where the doc_id is null
    ends     uint64 each: the document's end among the file's ids
    offsets  uint64 each: the byte at which each block starts, and the end of the last
    payload  blocks of BLOCK ids at `bits` bits each, lowest bit first; the last is padded to 8 ids

Null text counts as empty: a document always has its end id.  Repeated rows are kept, each as a document of its own;
ties in doc_id are ordered by the text's hash.  An empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, store

MAGIC = b"LTOK"
HEADER = struct.Struct("<4sHHIQQQ")
#: Ids in a block (a multiple of 8), and ids after which a file is closed at the next document's end.
BLOCK, FILE_IDS = 4096, 1 << 20
#: Words a worker remembers the ids of; beyond it the memory starts anew.
MEMORY = 900_000
#: A space that doesn't start a word.
WIDE = re.compile(r" (?=\s)| \Z")
FILES = "shard int, segment int, n_docs long, n_ids long, file binary"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids take exactly `bits` bytes: each of the eight columns is shifted into the bytes it touches."""
    rows = -(-len(ids) // 8)
    padded = np.zeros(rows * 8, np.uint64)
    padded[: len(ids)] = ids
    padded = padded.reshape(rows, 8)
    out = np.zeros((rows, bits), np.uint8)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        column = padded[:, j] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, byte + k] |= (column >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack(payload: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The first `count` ids of packed bytes."""
    rows = -(-count // 8)
    table = payload[: rows * bits].reshape(rows, bits)
    out = np.empty((rows, 8), np.uint32)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        column = np.zeros(rows, np.uint64)
        for k in range(-(-(shift + bits) // 8)):
            column |= table[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (column >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:count]


def write_file(doc_ids: list, ends: list[int], ids: np.ndarray, bits: int, before: int) -> bytes:
    offsets, blocks = [0], []
    for i in range(0, len(ids), BLOCK):
        blocks.append(pack(ids[i : i + BLOCK], bits))
        offsets.append(offsets[-1] + len(blocks[-1]))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join([
        HEADER.pack(MAGIC, bits, 1, BLOCK, len(doc_ids), len(ids), before),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        known.tobytes(),
        np.array(ends, "<u8").tobytes(),
        np.array(offsets, "<u8").tobytes(),
        *blocks,
    ])


class TokenFile:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, _, self.block, docs, self.n_ids, self.before = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.known = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
        self.ends = np.frombuffer(data, "<u8", docs, at := at + docs).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * docs).astype(np.int64)
        self.payload = np.frombuffer(data, np.uint8, offset=at + 8 * (blocks + 1))
        if len(self.payload) != self.offsets[-1]:
            raise ValueError("a token file is torn")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Only the blocks that hold [start, stop) are unpacked."""
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        count = min(self.n_ids, (last + 1) * self.block) - first * self.block
        whole = unpack(self.payload[self.offsets[first] : self.offsets[last + 1]], self.bits, count)
        return whole[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


class WordEncoder:
    """The tokenizers library over texts, remembering the ids of what stands between spaces.

    A space that is followed by something other than white space always starts a token of the byte-level pattern, so a
    text may be cut there and each piece, space included, encoded by itself.  Pieces are made of units: lines, and the
    full stop or comma after a word.  Units that are new go to the library together, one on a line: a line's end is a
    token of its own.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        probe = self.library.encode("a\n b\n c.", add_special_tokens=False).ids
        parts = [self.library.encode(x, add_special_tokens=False).ids for x in ("a", " b", " c.")]
        self.by_line = len(self.line) == 1 and probe == parts[0] + self.line + parts[1] + self.line + parts[2]
        #: The ids of pieces with a space before them, and of lines' beginnings after a line's end.
        self.known: dict[str, bytes] = {}
        self.marks = {"\r" + x: self.alone(x) for x in ".,"}

    def ids_of(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def alone(self, text: str) -> bytes:
        return self.ids_of(text).tobytes()

    @staticmethod
    def pieces(text: str) -> list[str]:
        """text cut at spaces before a word; all but the first stand for themselves with a space before them."""
        parts = text.split(" ")
        if not WIDE.search(text):
            return parts
        out = parts[:1]
        for x in parts[1:]:
            if x and not x[0].isspace():
                out.append(x)
            else:
                out[-1] += " " + x
        return out

    def units(self, piece: str) -> list[str] | None:
        """A piece's lines, and full stops and commas at their ends, each of which the pattern keeps apart.

        A line after the first starts with a line feed, a mark with a carriage return; None where white space needs the library.
        """
        lines = piece.split("\n")
        if not self.by_line or any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            return None
        out = []
        for i, x in enumerate(lines):
            lead = "\n" if i else ""
            if len(x) > 1 and x[-1] in ".," and x[-2] < "\u0250" and x[-2].isalpha():
                out += [lead + x[:-1], "\r" + x[-1]]
            else:
                out.append(lead + x)
        return out

    def split(self, joined: str, count: int) -> list[bytes] | None:
        """The ids of the lines of a text, unless they can't be told apart."""
        ids = self.ids_of(joined)
        ends = np.flatnonzero(ids == self.line[0])
        if len(ends) != count - 1:
            return None
        data = ids.tobytes()
        begins = [0, *(4 * ends + 4).tolist()]
        return [data[a : b - 4] for a, b in zip(begins, [*begins[1:], len(data) + 4], strict=True)]

    def learn(self, new: set[str]) -> None:
        known, marks = self.known, self.marks
        words: set[str] = set()
        lines: set[str] = set()
        made: dict[str, list[str]] = {}
        whole: list[str] = []
        ended: list[str] = []
        for x in new:
            if not self.by_line:
                whole.append(x)
            elif x.isalpha():
                words.add(x)
            elif x[-1] in ".," and x[-2:-1] < "\u0250" and x[:-1].isalpha():
                ended.append(x)
                if x[:-1] not in known:
                    words.add(x[:-1])
            elif (cut := self.units(x)) is None:
                whole.append(x)
            else:
                made[x] = cut
                for u in cut:
                    if u not in known and u not in marks:
                        (lines if u[0] == "\n" else words).add(u)
        for group, lead in ((words, " "), (lines, "")):
            todo = list(group)
            for i in range(0, len(todo), 2000):
                part = todo[i : i + 2000]
                found = self.split(lead + ("\n" + lead).join(part) if lead else "".join(part)[1:], len(part))
                known.update(zip(part, found or [self.alone(lead + u.lstrip("\n")) for u in part], strict=True))
        for x in ended:
            known[x] = known[x[:-1]] + marks["\r" + x[-1]]
        line = np.array(self.line, "<u4").tobytes()
        for x, cut in made.items():
            if cut != [x]:
                known[x] = b"".join(marks[u] if u in marks else line + known[u] if u[0] == "\n" else known[u] for u in cut)
        for x in whole:
            known[x] = self.alone(" " + x)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        for i in range(0, len(texts), 200):
            cut = [None if any(s in x for s in self.special) else self.pieces(x) for x in texts[i : i + 200]]
            if len(self.known) > MEMORY:
                self.known = {}
            new: set[str] = set()
            firsts = []
            for p in cut:
                firsts.append(p[0] if p else "")
                if p:
                    p[0] = ""
                    new.update(p)
            new.discard("")
            self.learn(new.difference(self.known))
            get = self.known.__getitem__
            for x, p, first in zip(texts[i : i + 200], cut, firsts, strict=True):
                if p is None:
                    yield self.alone(x)
                else:
                    self.known[""] = self.alone(first)
                    yield b"".join(map(get, p))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as token files in ascending id order: the table of files, read back from the shared folder."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, segment, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        bits = bits_for(max(enc.vocabulary, end_id + 1))
        end = np.array([end_id], "<u4").tobytes()
        doc_ids: list = []
        ends: list[int] = []
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [shard, segment, len(doc_ids), len(ids), write_file(doc_ids, ends, ids, bits, before)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["shard", "segment", "n_docs", "n_ids", "file"])

        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
                parts += (ids, end)
                doc_ids.append(doc_id)
                ends.append((ends[-1] if ends else 0) + len(ids) // 4 + 1)
                if ends[-1] >= FILE_IDS:
                    yield close()
                    before, segment = before + ends[-1], segment + 1
                    doc_ids, ends, parts = [], [], []
        if doc_ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return store(ranged.mapInArrow(files, FILES), "tokens", codec="lz4")


def read_tokens(files: DataFrame) -> DataFrame:
    """A row for each document of token files: doc_id, start among all ids, n_tokens, ids_crc32, and its shard and segment.

    Only one total a shard, of which there are as many as the writing exchange had partitions, comes to the driver.
    """
    totals = sorted((r["shard"], r["n"]) for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    starts, at = {}, 0
    for shard, n in totals:
        starts[shard] = at
        at += n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                f = TokenFile(data)
                ids, ends = f.ids(0, f.n_ids).astype("<u4"), f.ends.tolist()
                begins = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(f.doc_ids, pa.int64(), mask=f.known == 0),
                        pa.array(np.array(begins, np.int64) + f.before + starts[shard], pa.int64()),
                        pa.array(np.array(ends, np.int64) - np.array(begins, np.int64), pa.int64()),
                        pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)], pa.int64()),
                        pa.array([shard] * len(ends), pa.int32()),
                        pa.array([segment] * len(ends), pa.int32()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "segment"],
                )

    return files.select("shard", "segment", "file").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, segment int")


