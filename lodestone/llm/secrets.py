"""Secret scans, with DataFrame operations only: pattern rules, and Markov models of characters for the rest.

Rules find assignments to names of secrets, access keys and long hex strings.  Beyond them, tokens with a letter and at least
LONG characters, fewer than which a random string often stays under LEAST_TOTAL, are scored by two first-order Markov
models over ALPHABET, one of random strings and one of ordinary identifiers, by their log-likelihood ratio; tokens above both thresholds become spans of kind `random`, unless
a rule's span already covers them.

The models are trained from labelled samples: strings made from digests in the alphabets that keys use (random), and
identifiers made from the words of at most SAMPLE documents (the least hashes of doc_id), in lower, upper and title
case, with separators, numbers and dates (ordinary).  Only counts of character pairs come to the driver.

Positions are code points, ends exclusive.  Null text counts as empty and has no spans; repeated rows are kept; an
empty table gives no rows, and its models are trained from the made samples alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, furthest, let, page_range, pages, running

SAMPLE, LONG = 2000, 8
#: Log-likelihood ratio that a token needs in all, and on average for each pair of characters.
LEAST_TOTAL, LEAST_MEAN = 10.0, 0.4
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
# The rules' patterns, in the order in which kinds are listed.
RULES = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
KINDS = (*RULES, "random")
IN = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{IN}])[{IN}]{{{LONG},}}+"
MARKER = "[SECRET]"


def _quick(kind: str, text: Column) -> Column:
    """False only where the kind has no match at all."""
    if kind == "assign":
        return text.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    if kind == "access":
        return text.contains("AKIA")
    if kind == "hex":
        return text.rlike(r"[0-9a-f]{32}")
    return text.rlike(CANDIDATE)


def matches(text: Column, kind: str, pattern: str, keep) -> Column:
    """Spans (start, end, kind, value) of leftmost non-overlapping matches that keep(match) accepts.

    The text is cut into chunks that end with a match each; the last chunk is what is left.  A match ends where the
    lengths of its chunk and of those before it add up to.
    """
    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).*?(?:{pattern}|\z)"), F.lit(0))
    value = lambda c: F.regexp_extract(c, f"{pattern}\\z", 0)

    def span(chunk: Column, before: Column) -> Column:
        end = (before + F.length(chunk)).cast("int")
        return let(value(chunk), lambda v: F.struct((end - F.length(v)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), v.alias("value")))

    def found(cs: Column) -> Column:
        sizes = F.transform(cs, lambda c: F.length(c).cast("long"))
        return F.filter(F.zip_with(cs, running(sizes), span), lambda s: (F.length(s["value"]) > 0) & keep(s["value"]))

    return F.when(_quick(kind, text), let(chunks, found).cast(SPANS)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _pairs(words: DataFrame, label: str) -> DataFrame:
    """(label, pair, n) of the character pairs of (word, n)."""
    each = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2))))
    return words.where(F.length("word") > 1).select(each.alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).select(F.lit(label).alias("label"), "pair", "n")


def labelled_samples(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict[str, DataFrame]:
    """(word, n) of random strings and of ordinary identifiers."""
    spark: SparkSession = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 512)
    base64 = F.base64(F.unhex(digest))
    made = spark.range(4 * sample, numPartitions=1)
    upper = F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", ""))
    random = made.select(F.when(F.col("id") % 4 == 0, digest).when(F.col("id") % 4 == 1, base64).when(F.col("id") % 4 == 2, upper).otherwise(F.translate(base64, "+/", "-_")).alias("word"), F.lit(1).alias("n"))
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = given.select(F.col("id").alias("of")).orderBy(F.xxhash64("of"), "of").limit(sample)
    texts = given.join(F.broadcast(chosen.distinct()), F.col("id") == F.col("of")).select("text")
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    h = F.pmod(F.xxhash64("word"), F.lit(16))
    sep = F.element_at(F.array(*[F.lit(x) for x in "_-/="]), (h % 4 + 1).cast("int"))
    cased = F.when(h < 10, F.col("word")).when(h < 13, F.initcap("word")).otherwise(F.upper("word"))
    names = words.select(F.concat(sep, cased, sep).alias("word"), "n")
    number = F.col("id")
    plain = made.select(
        F.when(number % 3 == 0, F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), number.cast("int")), "yyyy-MM-dd"))
        .when(number % 3 == 1, F.concat(F.lit("v"), number % 10, F.lit("_"), number % 100))
        .otherwise(F.concat(F.lit("_"), number * 7919, F.lit("-"), number % 1000))
        .alias("word"),
        F.lit(1).alias("n"),
    )
    return {"random": random, "ordinary": names.unionByName(plain)}


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log-likelihood ratios (random over ordinary) of a character after another, row by row of ALPHABET."""
    size = len(ALPHABET)
    counts = {label: [[0.5] * size for _ in range(size)] for label in ("random", "ordinary")}
    samples = labelled_samples(docs, sample, id_col, text_col)
    pairs = _pairs(samples["random"], "random").unionByName(_pairs(samples["ordinary"], "ordinary"))
    for r in pairs.collect():  # at most one row a label and pair of ASCII characters
        a, b = ALPHABET.find(r["pair"][0]), ALPHABET.find(r["pair"][1])
        if a >= 0 and b >= 0:
            counts[r["label"]][a][b] += r["n"]
    out = []
    for a in range(size):
        x, y = sum(counts["random"][a]), sum(counts["ordinary"][a])
        out += [round(math.log(counts["random"][a][b] / x) - math.log(counts["ordinary"][a][b] / y), 4) for b in range(size)]
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a token's characters (of ALPHABET), each after the one before."""
    place = {ord(c): i for i, c in enumerate(ALPHABET)}
    size, last = len(ALPHABET), max(place) + 1
    # a cell for each pair of character codes, so that a code is its own place
    cells = ["0" if a not in place or b not in place else str(model[place[a] * size + place[b]]) for a in range(last) for b in range(last)]
    table = F.split(F.lit(",".join(cells)), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), F.ascii)
    first = F.struct(F.lit(0).alias("was"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(c.alias("was"), (acc["sum"] + F.get(table, acc["was"] * last + c)).alias("sum"))
    return F.aggregate(codes, first, step)["sum"]


def looks_random(token: Column, model: list[float]) -> Column:
    score = ratio(token, model)
    return (score >= LEAST_TOTAL) & (score >= LEAST_MEAN * (F.length(token) - 1))


def spans_of(text: Column, model: list[float]) -> tuple[Column, Column]:
    """(spans of the rules, tokens that the models call random), each by start and kind."""
    anything = lambda value: F.lit(True)
    long_value = lambda value: F.length(F.regexp_extract(value, RULES["assign"], 2)) >= 8
    rules = [matches(text, kind, pattern, long_value if kind == "assign" else anything) for kind, pattern in RULES.items()]
    tokens = matches(text, "random", CANDIDATE, lambda v: v.rlike("[A-Za-z]") & looks_random(v, model))
    return F.array_sort(F.concat(*rules)), tokens


def scan(docs: DataFrame, model: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col, base, spans) of every row: arrays of (start, end, kind, value), by start and then kind."""
    model = train(docs, id_col=id_col, text_col=text_col) if model is None else model
    base, tokens = spans_of(F.coalesce(F.col(text_col), F.lit("")), model)
    a, b = fresh([id_col, text_col], "base", "tokens")
    found = docs.select(id_col, text_col, base.alias(a), tokens.alias(b))
    return found.select(id_col, text_col, a, with_random(F.col(a), F.col(b)).alias("spans"))


def with_random(base: Column, tokens: Column) -> Column:
    """The rules' spans and the random tokens that none of them covers, by start and kind.

    Spans of a rule don't overlap, so of the rules' spans that begin at or before a token's start only the last of each
    kind can cover it.  All spans are sorted at once, by start and with a token after the rules' spans of its start, and
    one pass over them knows the furthest end so far.
    """
    random = F.lit(KINDS.index("random"))
    alone = F.size(base) == 0
    every = F.array_sort(F.concat(base, tokens))
    ends = lambda xs: F.transform(xs, lambda s: F.when(s["kind"] == random, F.lit(0)).otherwise(s["end"]))
    kept = let(every, lambda xs: F.filter(F.zip_with(xs, furthest(ends(xs)), lambda s, far: F.when((s["kind"] != random) | (far < s["end"]), s)), lambda s: s.isNotNull()))
    return F.when(alone, tokens).otherwise(F.when(F.size(tokens) == 0, base).otherwise(kept))


def named(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(kinds, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def report(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """doc_id, counts of the rules' spans, their digest, and all spans as a string."""
    found = scan(docs.select("doc_id", "text"), model)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in RULES], F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each stretch that spans (by start) cover or join up to replaced by MARKER."""
    stretches = lambda xs: F.zip_with(xs, furthest(F.transform(xs, lambda s: s["end"])), lambda s, far: F.struct(s["start"].alias("start"), s["end"].alias("end"), far.alias("far")))

    def piece(cut: Column, s: Column) -> Column:
        """What stands between the span and those before it, and the marker, unless the span is a part of their stretch."""
        at = F.greatest(s["far"], F.lit(0))
        return F.when(s["start"] < at, "").otherwise(F.concat(page_range(cut, at, s["start"]), F.lit(MARKER)))

    def body(cut: Column) -> Column:
        rest = page_range(cut, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text))
        return F.concat(F.array_join(F.transform(stretches(spans), lambda s: piece(cut, s)), ""), rest)

    return F.when(F.size(spans) > 0, let(pages(text), body)).otherwise(text)


def redact(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """docs, all columns, with secrets replaced in the texts; n_chars, if there, is the new length where that changes."""
    model = train(docs) if model is None else model
    base, tokens = fresh(docs.columns, "base", "tokens")
    rules, candidates = spans_of(F.coalesce(F.col("text"), F.lit("")), model)
    found = docs.select("*", rules.alias(base), candidates.alias(tokens))
    found = found.select(*docs.columns, with_random(F.col(base), F.col(tokens)).alias(base))
    out = found.withColumn("text", redacted(F.col("text"), F.col(base)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(base) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
