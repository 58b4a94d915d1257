"""Secret scans: fixed patterns, and Markov models of random strings and ordinary identifiers.

Two first-order character models are trained from labelled tokens, one
from random strings and one from ordinary identifiers.  A token is taken
for a secret when its log-likelihood ratio (random against identifier)
exceeds ``MARGIN`` in all and ``PER_CHAR`` on average per transition.

All of it is DataFrame code.  Matches are not searched by position: a
text is its matches and the gaps between them in turn, so running sums
of their lengths (one window per document and kind) give all spans in
code points.  A document's spans are grouped by a row number of the scan;
no other key is shuffled.

Training counts character pairs of labelled tokens in Spark.  The tokens
come from a sample of documents whose expected number is ``SAMPLE_ROWS``
(a hash of ``doc_id`` decides; smaller tables are taken whole): what the
fixed patterns find counts as random, other identifiers as ordinary.  The
driver gathers at most 2 x 128 x 128 counts.

Defined cases: a null text counts as empty; a null ``doc_id`` is kept;
repeated rows are scanned one by one; without labelled tokens both models
are uniform and the method adds nothing; other columns are ignored by
``scan`` and kept by ``redact``; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_KEY = r"(?i)password|passwd|secret|token|api_?key"
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # [0-9a-f]+ of 16 characters or more
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_][A-Za-z0-9_]{5,}(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE_ROWS = 20_000
PSEUDO = 32.0
MARGIN, PER_CHAR = 12.0, 0.7
PLACEHOLDER = "[SECRET]"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _matches(pattern: str, may: str | None = None) -> Column:
    found = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    return found if may is None else F.when(F.col("t").rlike(may), found).otherwise(F.array().cast("array<string>"))


def _value(match) -> Column:
    """The assigned value of an ``ASSIGN`` match."""
    return F.regexp_extract(match, ASSIGN, 2)


def _chars(token) -> Column:
    return F.split(token, "")


def _pairs(token) -> Column:
    """Places of a token's transitions in a 128 x 128 table."""
    code = F.transform(_chars(token), lambda c: F.ascii(c))
    n = F.size(code)
    return F.zip_with(F.slice(code, 1, n - 1), F.slice(code, 2, n - 1), lambda a, b: a * 128 + b)


def labelled_tokens(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``token, random``: labelled by the fixed patterns, from a bounded sample of documents."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    picked = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)), F.lit(share >= 1))
    t = docs.where(picked).select(_text().alias("t"))
    values = F.filter(F.transform(_matches(ASSIGN, ASSIGN_KEY), _value), lambda v: F.length(v) >= ASSIGN_VALUE)
    tagged = t.select("t", F.concat(values, _matches(ACCESS), _matches(HEX)).alias("found"))
    random = tagged.select(F.explode("found").alias("token"), F.lit(True).alias("random"))
    ordinary = tagged.select(F.explode(_matches(IDENTIFIER)).alias("token"), F.lit(False).alias("random"))
    return random.union(ordinary.where(~F.col("token").rlike(f"{HEX}|{ACCESS}")))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition (128 x 128 table) from rows of ``token, random``."""
    pairs = labelled.where(F.length("token") > 1).select("random", F.explode(_pairs("token")).alias("pair"))
    counts = {True: [0] * (128 * 128), False: [0] * (128 * 128)}
    for r in pairs.where("pair < 16384").groupBy("random", "pair").count().collect():  # at most 2 x 128 x 128 rows
        counts[r["random"]][r["pair"]] = r["count"]
    codes = [ord(c) for c in ALPHABET]
    if not any(counts[False]):
        return [0.0] * (128 * 128)
    log: dict[bool, list[float]] = {}
    for label, n in counts.items():
        log[label] = [0.0] * (128 * 128)
        for a in codes:
            row = sum(n[a * 128 + b] for b in codes)
            for b in codes:
                log[label][a * 128 + b] = math.log((n[a * 128 + b] + PSEUDO / len(codes)) / (row + PSEUDO))
    return [round(x - y, 6) for x, y in zip(log[True], log[False])]


def is_random(token, ratios: list[float], margin: float = MARGIN, per_char: float = PER_CHAR) -> Column:
    """Whether a token's log-likelihood ratio speaks for a random string."""
    table = F.lit(np.array(ratios))  # one array literal
    total = F.aggregate(_pairs(token), F.lit(0.0), lambda s, p: s + F.get(table, p))
    return (total >= margin) & (total >= per_char * (F.length(token) - 1))


def _parts(ratios: list[float]) -> list[Column]:
    """For each kind an array of the matches in ``t``: kind, length of the gap before, length, and whether the match counts."""
    def lengths(kind):
        keep = {0: lambda m: F.length(_value(m)) >= ASSIGN_VALUE, 3: lambda m: is_random(m, ratios)}.get(kind, lambda m: F.lit(True))
        return lambda m: F.struct(F.length(m).alias("n"), keep(m).alias("keep"))

    def with_gaps(kind):
        return lambda p, g: F.struct(F.lit(kind).alias("kind"), g.cast("long").alias("gap"), p["n"].cast("long").alias("n"), p["keep"].alias("keep"))

    parts = []
    for kind, pattern, may in ((0, ASSIGN, ASSIGN_KEY), (1, ACCESS, "AKIA"), (2, HEX, HEX), (3, TOKEN, TOKEN)):
        found = _matches(pattern, may)
        gaps = F.when(F.col("t").rlike(may), F.transform(F.split("t", pattern, -1), lambda g: F.length(g)))
        gaps = F.slice(F.coalesce(gaps, F.array().cast("array<int>")), 1, F.size(found))
        parts.append(F.zip_with(F.transform(found, lengths(kind)), gaps, with_gaps(kind)))
    return parts


def spans(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """``row, doc_id, kind`` (place in ``KINDS``) ``, start, end`` of all spans; a document without any has one row of nulls."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("t")).withColumn("row", F.monotonically_increasing_id())
    m = t.select("row", "doc_id", F.posexplode_outer(F.concat(*_parts(ratios))).alias("i", "m")).select("row", "doc_id", "i", "m.*").repartition("row")
    so_far = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("n")).over(so_far)
    m = m.select("row", "doc_id", "kind", "keep", (end - F.col("n")).alias("start"), end.alias("end"))
    # a span of the method goes only where fixed patterns cover all of it: they form islands of
    # overlapping or touching spans, and the last one that begins at or before it must reach its end
    fixed = (F.col("kind") < 3) & F.col("keep")
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    m = m.withColumn("reach", F.max(F.when(fixed, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.when(fixed & (F.col("reach").isNull() | (F.col("start") > F.col("reach"))), 1).otherwise(0)
    m = m.withColumn("island", F.sum(begins).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    m = m.withColumn("island_end", F.max(F.when(fixed, F.col("end"))).over(Window.partitionBy("row", "island")))
    covered = F.coalesce(F.col("island_end") >= F.col("end"), F.lit(False))
    kept = F.col("keep") & ((F.col("kind") < 3) | ~covered)
    null = F.lit(None)
    return m.select("row", "doc_id", F.when(kept, F.col("kind")).otherwise(null).alias("kind"), F.when(kept, F.col("start")).otherwise(null).alias("start"), F.when(kept, F.col("end")).otherwise(null).alias("end"))


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Per document the counts of the fixed patterns, a digest of their spans, and all spans."""
    name = F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("kind") + 1)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", F.concat_ws(":", name, F.col("start"), F.col("end")).alias("span")))
    found = spans(docs, ratios).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda s: s["span"]), ",")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, ratios: list[float], placeholder: str = PLACEHOLDER) -> DataFrame:
    """``docs`` with the union of the spans that ``scan`` finds replaced in
    ``text``, one placeholder for each stretch; texts without secrets stay as they are."""
    span = "array<struct<start:long,end:long>>"
    null = F.lit(None).cast("long")

    def placed(part):
        """Spans of the matches that count."""
        def step(acc, m):
            start = acc["at"] + m["gap"]
            new = F.concat(acc["spans"], F.array(F.struct(start.alias("start"), (start + m["n"]).alias("end"))))
            return F.struct((start + m["n"]).alias("at"), F.when(m["keep"], new).otherwise(acc["spans"]).alias("spans"))
        return F.aggregate(part, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans")), step)["spans"]

    def joined(acc, s):
        """Stretches that are done, and the one that still grows."""
        grows = s["start"] <= acc["end"]
        done = F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))
        return F.when(acc["end"].isNull(), F.struct(acc["done"].alias("done"), s["start"].alias("start"), s["end"].alias("end"))) \
            .when(grows, F.struct(acc["done"].alias("done"), acc["start"].alias("start"), F.greatest(acc["end"], s["end"]).alias("end"))) \
            .otherwise(F.struct(done.alias("done"), s["start"].alias("start"), s["end"].alias("end")))

    out = docs.select(F.struct(*docs.columns).alias("doc"), _text().alias("t"))
    out = out.withColumn("found", F.array_sort(F.concat(*(placed(p) for p in _parts(ratios)))))
    start = F.struct(F.array().cast(span).alias("done"), null.alias("start"), null.alias("end"))
    union = F.aggregate("found", start, joined, lambda a: F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))))
    out = out.withColumn("union", F.when(F.size("found") > 0, union))
    # each stretch with the text before it, then the rest
    from_ = lambda i: F.coalesce(F.get("union", i - 1)["end"], F.lit(0))
    cut = lambda a, n: F.col("t").substr((a + 1).cast("int"), n.cast("int"))
    before = F.transform("union", lambda s, i: F.concat(cut(from_(i), s["start"] - from_(i)), F.lit(placeholder)))
    rest = cut(F.element_at("union", -1)["end"], F.length("t").cast("long"))
    text = F.when(F.col("union").isNotNull(), F.concat(F.array_join(before, ""), rest)).otherwise(F.col("doc")["text"])
    return out.select(*(text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))
