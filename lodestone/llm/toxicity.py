"""Toxicity by a weighted lexicon, learned from labels and matched with Aho-Corasick.

Texts are folded first: compatibility forms to plain ones, lower case, zero-width characters and combining marks that
make no letter of their own taken out (accents of letters stay: words differ by them), look-alikes of other scripts to Latin letters, digits and signs that stand for letters to those
letters (`!` and `|` only between letters).  Lexicon entries are whole words or word beginnings.  A match inside an
exception phrase doesn't count.  The score is logistic in the summed weights over a power of the text's length in words.
The power is one of POWERS, the one with the least loss on the training rows: labels mark texts with a few words of
abuse in many as they mark short ones, so the full length may take too much.

Learning uses at most SAMPLE labelled rows (the least hashes of doc_id, so every run takes the same), never those whose
crc32(doc_id as text) mod 5 is 0: beginnings and words are counted in toxic documents, then in the others; the lexicon
takes the entry that explains most toxic documents not explained so far, again and again, so that words of mere copies
of a document bring nothing; then a ridge logistic regression sets the scale.  Phrases of an entry and a neighbour that
clean documents have and toxic ones don't become exceptions.

Defined results: null and empty texts score as a text without matches; repeated rows are scored each; a null doc_id is
in training's share nowhere and isn't held out (null); labels other than 0 and 1 are no labels; where no labels are
there, nothing is learned and every score is the prior's; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, only, partitions, store

#: Labelled rows that are learned from at most; folds of which one is held out.
SAMPLE, FOLDS = 16_000, 5
#: Characters of a word's beginning that may be an entry.
SHORTEST, LONGEST = 4, 8
#: Toxic documents that an entry must explain anew.
LEAST = 3
#: Log odds that an entry must add at least.
STRONG = 3.0
#: Powers of the length that are tried.
POWERS = (0.0, 0.125, 0.25, 0.5, 1.0)
# Characters of other scripts that look like Latin letters, and those letters.
LOOKALIKES = dict(
    zip(
        "абгеєорсухіїјѕԁһӏвкмнтпигԛԝзь" "αβγδεζηικμνορτυχω" "ıłøđßƒɑɡɩʟʀʏℓ",
        "abreeopcyxiijsdhlbkmhtnurqwzb" "abydeznikmvoptuxw" "ilodsfagilryl",
        strict=True,
    )
)
# Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l"}
# Signs that stand for letters between letters only.
INNER = {"!": "i", "|": "l"}
#: Combining marks, soft hyphens, zero-width characters and marks of direction.
UNSEEN = dict.fromkeys([*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10), 0xFEFF])
FOLD = str.maketrans(LOOKALIKES | DIGITS) | UNSEEN
WORD = re.compile(r"[^\W\d_]+")
INSIDE = re.compile(r"(?<=[^\W_])[!|](?=[^\W_])")


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "!" in text or "|" in text:
        text = INSIDE.sub(lambda m: INNER[m[0]], text)
    return text.lower().translate(FOLD)


def parts_of(word: str) -> Iterator[str]:
    """What may be an entry of the word: '=word', or '^' and a beginning."""
    yield "=" + word
    for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1):
        yield "^" + word[:n]


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    power: float = 0.25
    slope: float = 1.0
    bias: float = -3.0

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        by: dict[str, dict[str, float]] = {}
        for entry, weight in self.weights.items():
            by.setdefault(entry[1:], {})[entry[0]] = weight
        for key, kinds in by.items():
            made.add_word(key, (key, kinds))
        for phrase in self.exceptions:
            if phrase not in by:
                made.add_word(phrase, (phrase, {}))
        made.make_automaton()
        return made

    def matches(self, folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
        """(start, end, entry) of what counts: at a word's start, whole words at its end too, outside exceptions."""
        found, shielded = [], []
        phrases = set(self.exceptions)
        for last, (key, kinds) in automaton.iter(folded):
            start, end = last - len(key) + 1, last + 1
            if start and folded[start - 1].isalpha():
                continue
            closed = end == len(folded) or not folded[end].isalpha()
            if key in phrases and closed:
                shielded.append((start, end))
            if "^" in kinds:
                found.append((start, end, "^" + key))
            if "=" in kinds and closed:
                found.append((start, end, "=" + key))
        if shielded:
            shielded.sort()
            starts, reach = [a for a, _ in shielded], list(accumulate((b for _, b in shielded), max))
            # a match is covered if a phrase that starts at or before it reaches to its end
            found = [x for x in found if not (i := bisect_right(starts, x[0])) or reach[i - 1] < x[1]]
        return found

    def found(self, text: str, automaton: ahocorasick.Automaton) -> tuple[float, int, int]:
        """Summed weights, the length in words (gaps and one), and the number of matches."""
        folded = fold(text)
        found = self.matches(folded, automaton) if self.weights else []
        return sum(self.weights[e] for _, _, e in found), 1 + folded.count(" ") + folded.count("\n"), len(found)

    def evidence(self, text: str, automaton: ahocorasick.Automaton) -> tuple[float, int]:
        """Summed weights over the length's power, and the number of matches."""
        total, length, n = self.found(text, automaton)
        return total / length**self.power, n

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.bias, -30, 30)))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most `sample` labelled documents outside the held-out fold, in the shared folder."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(sample)
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    one = joined.select("labelled", F.coalesce("text", F.lit("")).alias("text"), "toxic").dropDuplicates(["labelled", "text"])
    return store(one.repartition(partitions(docs.sparkSession), "labelled"), "labelled")


def _counted(rows: DataFrame, of) -> dict[tuple[str, int], int]:
    """Sums of what of(texts, labels) counts, task by task and then over all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        total: Counter = Counter()
        for batch in batches:
            of(total, batch.column(0).to_pylist(), batch.column(1).to_pylist())
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], names=["entry", "toxic", "n"])

    made = rows.select("text", F.col("toxic").cast("int")).mapInArrow(count, "entry string, toxic int, n long")
    return made.groupBy("entry", "toxic").agg(F.sum("n").alias("n"))


def _weight(pos: int, neg: int, toxic: int, clean: int) -> float:
    return math.log((pos + 0.5) / (toxic - pos + 0.5)) - math.log((neg + 0.5) / (clean - neg + 0.5))


def _cover(having: list[set[str]], pos: dict[str, int], neg: dict[str, int], toxic: int, clean: int) -> dict[str, float]:
    """Entries, each the one that then explains most toxic documents, of equals the most specific."""
    weight = {e: _weight(n, neg.get(e, 0), toxic, clean) for e, n in pos.items()}
    good = {e for e, w in weight.items() if w > STRONG and pos[e] > 20 * neg.get(e, 0) * toxic / max(clean, 1)}
    left = [x & good for x in having]
    gain = Counter(e for x in left for e in x)
    where: dict[str, list[int]] = {}
    for i, x in enumerate(left):
        for e in x:
            where.setdefault(e, []).append(i)
    out: dict[str, float] = {}
    while gain:
        most = max(gain[e] * weight[e] for e in gain)
        close = [e for e in gain if gain[e] * weight[e] >= 0.97 * most]
        best = max(close, key=lambda e: (len(e) + (e[0] == "="), gain[e], e))
        if gain[best] < LEAST:
            break
        out[best] = weight[best]
        for i in where[best]:
            for e in left[i]:
                gain[e] -= 1
            left[i] = set()
        gain = +gain
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Learn a lexicon from at most `sample` labelled rows; what comes to the driver is bounded by that number."""
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, sample)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        share = (toxic + 0.5) / (toxic + clean + 1)
        return Lexicon(bias=math.log(share / (1 - share)))
    bad = rows.where("toxic = 1")

    def all_parts(total: Counter, texts: list[str], marks: list[int]) -> None:
        for text in texts:
            total.update({(p, 1) for w in set(WORD.findall(fold(text))) for p in parts_of(w)})

    least = max(LEAST, toxic // 1000)
    pos = {r["entry"]: r["n"] for r in _counted(bad, all_parts).where(F.col("n") >= least).collect()}

    def known_parts(total: Counter, texts: list[str], marks: list[int]) -> None:
        for text in texts:
            total.update({(p, 0) for w in set(WORD.findall(fold(text))) for p in parts_of(w) if p in pos})

    neg = {r["entry"]: r["n"] for r in _counted(rows.where("toxic = 0"), known_parts).collect()}
    rare = {p for p, n in pos.items() if n > 20 * neg.get(p, 0) * toxic / clean}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for batch in batches:
            found = [sorted({p for w in set(WORD.findall(fold(t))) for p in parts_of(w) if p in rare}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["parts"])

    having = [set(r["parts"]) for r in bad.select("text").mapInArrow(held, "parts array<string>").toLocalIterator()]
    lexicon = Lexicon(_cover(having, pos, neg, toxic, clean))

    def neighbours(total: Counter, texts: list[str], marks: list[int]) -> None:
        made = lexicon.automaton()
        for text, mark in zip(texts, marks, strict=True):
            folded, phrases = fold(text), set()
            for a, b, _ in lexicon.matches(folded, made):
                after, before = WORD.match(folded, b + 1), WORD.findall(folded[max(0, a - 40) : a])
                if after and folded[b : b + 1] == " ":
                    phrases.add((folded[a : after.end()], mark))
                if before and folded[max(0, a - 1) : a] == " ":
                    phrases.add((f"{before[-1]} {folded[a:b]}", mark))
            total.update(phrases)

    if lexicon.weights:
        seen: dict[str, list[int]] = {}
        for r in _counted(rows, neighbours).collect():
            seen.setdefault(r["entry"], [0, 0])[r["toxic"]] += r["n"]
        harmless = [p for p, (n, y) in sorted(seen.items()) if n >= LEAST and _weight(y, n, toxic, clean) < 0]
        lexicon.exceptions = tuple(harmless)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        made = lexicon.automaton()
        for batch in batches:
            found = [lexicon.found(t, made) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in found], pa.float64()), pa.array([n for _, n, _ in found], pa.int64()), batch.column(1)], names=["x", "length", "toxic"])

    points = rows.select("text", F.col("toxic").cast("int")).mapInArrow(measured, "x double, length long, toxic int").collect()
    x, length, y = (np.array([p[i] for p in points], float) for i in range(3))
    lexicon.power, lexicon.slope, lexicon.bias = _scaled(x, length, y)
    return lexicon


def _scaled(x: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """The power, slope and bias with the least loss, both classes weighing the same; of equals the greatest power."""
    tried = []
    for power in POWERS:
        slope, bias = _logistic(x / length**power, y)
        p = 1 / (1 + np.exp(-np.clip(slope * x / length**power + bias, -30, 30)))
        loss = -np.log(p[y == 1]).mean() - np.log(1 - p[y == 0]).mean()
        tried.append((round(float(loss), 6), -power, slope, bias))
    _, power, slope, bias = min(tried)
    return -power, slope, bias


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and bias by Newton's method; both classes weigh the same, and the ridge keeps separable data finite."""
    order = np.lexsort((y, x))  # the rows' order must not show in the sums
    x, y = x[order], y[order]
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (each * (y - p)) - np.array([ridge * 0.01, ridge * 0.01]) * beta
        hessian = (design * (each * p * (1 - p))[:, None]).T @ design + np.eye(2) * ridge * 0.01
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return round(float(max(beta[0], 0.0)), 6), round(float(beta[1]), 6)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of matches of every row."""
    bounded_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        made = lexicon.automaton()
        for batch in batches:
            found = [lexicon.evidence(t or "", made) for t in batch.column(1).to_pylist()]
            p = lexicon.probability(np.array([x for x, _ in found], float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "score", "n_matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double, n_matches long")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of docs, all columns, that aren't predicted toxic."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        made = lexicon.automaton()
        for batch in batches:
            p = lexicon.probability(np.array([lexicon.evidence(t or "", made)[0] for t in batch.column(at).to_pylist()], float))
            yield batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(clean, docs.schema)
