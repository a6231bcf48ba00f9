"""SentencePiece BPE encoding by backtracking, and decoding, exactly as the library's for identity-normalised models.

A text's BPE encoding is the one sequence of pieces in which every adjacent pair is compatible, that is, merging the
pair's characters anew gives the pair back.  The encoder takes the longest piece that an Aho-Corasick automaton finds
at a position, checks it against the piece before by re-merging (remembered by pair), and on a dead end goes back,
marking the position in a bitfield of failed positions: it is never tried again, so the work is linear.

Pieces that share the lowest score (runs of the space mark) are merged last and from the left, which no order of pieces
can say; they are kept out of the automaton and merged afterwards.  A mark that follows another character always starts
a new piece, so texts are cut there and the ids of each cut are remembered.

Null text counts as empty: it has the end id only, and decodes to the empty text.  Repeated rows are kept; an empty
table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, only

MARK = "▁"
#: Cuts and pairs of pieces that a worker remembers; beyond it the memory starts anew.
MEMORY, PAIRS = 700_000, 1_000_000


codecs.register_error("one-by-one", lambda e: ("\ufffd", e.start + 1))


class Pieces:
    """A BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity-normalised BPE models with a dummy prefix are read")
        library = SentencePieceProcessor(model_file=path)
        self.size, self.end, self.unknown = library.piece_size(), library.eos_id(), library.unk_id()
        score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.surface: list[bytes] = []
        self.is_byte = np.zeros(self.size, bool)
        byte_ids: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            self.surface.append(b"")
            if p.type == p.NORMAL:
                self.id[p.piece], score[p.piece] = i, p.score
                self.surface[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == p.BYTE:
                byte_ids[int(p.piece[3:5], 16)] = i
                self.surface[i], self.is_byte[i] = bytes([int(p.piece[3:5], 16)]), True
            elif p.type in (p.USER_DEFINED, p.UNUSED):
                raise ValueError("user-defined and unused pieces are not read")
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.bytes = [byte_ids[b] for b in range(256)]
        seen: dict[float, list[str]] = {}
        for p, s in score.items():
            if len(p) > 1:
                seen.setdefault(s, []).append(p)
        tied = [p for ps in seen.values() if len(ps) > 1 for p in ps]
        if any(set(p) != {MARK} for p in tied) or tied and score[tied[0]] > min(score[p] for p in score if len(p) > 1):
            raise ValueError("pieces of equal score other than runs of the space mark")
        if any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) and p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece goes on over a space")
        self.runs = {p for p in self.id if len(p) > 1 and set(p) == {MARK}}
        if not self.runs <= set(tied):
            raise ValueError("runs of the space mark differ in score")
        self.rank = {p: -s for p, s in score.items() if len(p) > 1 and p not in self.runs}
        self.automaton = ahocorasick.Automaton()
        for p in self.rank:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.decimal = [str(i).encode() for i in range(self.size)]

    def merged(self, text: str) -> list[str]:
        """Plain BPE: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = min(((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(np.inf, 0))
            if best[0] == np.inf:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def fits(self, a: str, b: str) -> bool:
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) >= PAIRS:
                self.compatible = {}
            known = self.compatible[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text without runs of marks; a character that is no piece stands for itself."""
        lengths: list[list[int]] = [[1] for _ in text]
        for end, n in self.automaton.iter(text):
            lengths[end - n + 1].append(n)
        for found in lengths:
            if len(found) > 2:
                found.sort()
        failed = bytearray((len(text) >> 3) + 1)
        out: list[str] = []
        tried: list[int] = [len(lengths[0])]
        at, last, total = 0, "", len(text)
        while at < total:
            found = lengths[at]
            i = tried[-1]
            while i:
                i -= 1
                to = at + found[i]
                if not failed[to >> 3] >> (to & 7) & 1:
                    piece = text[at:to]
                    if self.fits(last, piece):
                        tried[-1] = i
                        out.append(piece)
                        at, last = to, piece
                        tried.append(len(lengths[at]) if at < total else 0)
                        break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                tried.pop()
                if not out:
                    raise AssertionError("a text without an encoding")
                at -= len(out.pop())
                last = out[-1] if out else ""
        return out

    def grouped(self, count: int) -> list[str]:
        """Marks in a row, merged from the left: of pairs that may merge, always the leftmost."""
        size, after, before = [1] * count, list(range(1, count + 1)), list(range(-1, count - 1))
        todo = [(i, 2) for i in range(count - 1)]
        while todo:
            i, n = heapq.heappop(todo)
            j = after[i] if size[i] else count
            if not size[i] or j >= count or size[i] + size[j] != n or MARK * n not in self.runs:
                continue
            size[i], size[j], after[i] = n, 0, after[j]
            if after[j] < count:
                before[after[j]] = i
                heapq.heappush(todo, (i, n + size[after[j]]))
            if before[i] >= 0:
                heapq.heappush(todo, (before[i], n + size[before[i]]))
        return [MARK * n for n in size if n]

    def cut_ids(self, cut: str) -> bytes:
        """Ids of marks and then other characters."""
        marks = len(cut) - len(cut.lstrip(MARK))
        pieces = self.backtrack(cut[max(0, marks - 1) :])
        if marks > 1:
            run = marks - 1
            if pieces[0] == MARK:
                run, pieces = marks, pieces[1:]
            pieces = self.grouped(run) + pieces
        ids: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            if i is None:
                ids += [self.bytes[b] for b in p.encode()]
            else:
                ids.append(i)
        return np.array(ids, "<u4").tobytes()

    def learn(self, cut: str) -> bytes:
        """A cut that ends in a full stop or comma is taken from the cut without it, if the two keep apart."""
        if cut[-1] in ".," and len(cut) > 2:
            head = self.known.get(cut[:-1])
            if head is None:
                head = self.known[cut[:-1]] = self.cut_ids(cut[:-1])
            last = int.from_bytes(head[-4:], "little")
            if not self.is_byte[last] and self.fits(self.text_of[last], cut[-1]):
                return head + np.array([self.id[cut[-1]]], "<u4").tobytes()
        return self.cut_ids(cut)

    @property
    def text_of(self) -> list[str]:
        if not hasattr(self, "_text_of"):
            self._text_of = [""] * self.size
            for p, i in self.id.items():
                self._text_of[i] = p
        return self._text_of

    def encode(self, text: str) -> bytes:
        """The ids, without the end id, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if MARK in text:
            text = text.replace(MARK, " ")
        if len(self.known) > MEMORY:
            self.known = {}
        known, out, held = self.known, [], ""
        for x in text.split(" "):
            if not x:
                held += MARK
                continue
            cut = held + MARK + x if held else MARK + x
            held = ""
            ids = known.get(cut)
            if ids is None:
                ids = known[cut] = self.learn(cut)
            out.append(ids)
        if held:
            out.append(self.cut_ids(held))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: each byte that is no UTF-8 becomes a replacement character, one space goes in front."""
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if len(ids) and data[:1] == b" " and not self.is_byte[ids[0]]:
            data = data[1:]
        if self.is_byte[ids].any():
            data = data.decode("utf-8", "one-by-one").encode()
        return data


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_column(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids as little-endian 32-bit integers, end id included."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pieces", _models)
        m = pieces(model)
        end = np.array([m.end], "<u4").tobytes()
        for batch in batches:
            counts, digests, decoded, raw = [], [], [], []
            for text in batch.column(1).to_pylist():
                data = m.encode(text or "") + end
                ids = np.frombuffer(data, "<u4")
                counts.append(len(ids))
                digests.append(hashlib.sha256(b" ".join(map(m.decimal.__getitem__, ids.tolist()))).hexdigest())
                decoded.append(hashlib.sha256(m.decode(ids)).hexdigest())
                if with_ids:
                    raw.append(data)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(raw, pa.binary())] * with_ids], names=names)

    made = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, made)


def decode_column(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of ids stored as little-endian 32-bit integers; null ids give a null text."""
    bounded_batches(tokens.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pieces", _models)
        m = pieces(model)
        for batch in batches:
            texts = [None if x is None else m.decode(np.frombuffer(x, "<u4")).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(rows, "doc_id long, text string")
