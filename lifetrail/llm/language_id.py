"""Multilingual mixture inference.

Model: every language is a distribution over character trigrams of the
lower-cased letters of a text (words are set off by blanks), hashed to
``BUCKETS`` places and smoothed.  A document is a mixture of languages:
expectation-maximisation estimates its proportions from the trigrams'
likelihoods.  Which languages it holds is chosen by penalised likelihood:
starting from the best single one, the language that raises the
likelihood most is added as long as twice the gain, divided by the number
of trigrams that overlap (three), exceeds log(trigrams).

Training counts trigrams in Spark, by language and bucket, over a sample
of labelled rows whose expected size is ``sample_rows`` (a hash of the row
decides; tables up to that size are taken whole).  The sample is bounded
per language: languages up to one common bound, ``LEAST_ROWS`` or more,
are taken whole, larger ones by a hash share, so every language is learned
at every size of the table.  The driver has one count per language.  The model
has at most ``BUCKETS`` rows per language and is the only thing the
driver gathers; prediction is one pass over the documents.

Defined cases: a null text, or one without letters, gets ``und`` and
score 0; without any labelled row every text gets ``und``; ties go to the
language that sorts first; a null label is not learned from; repeated
rows are predicted one by one; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from lifetrail.llm.common import lean, whole_text
from lifetrail.llm.textbytes import LETTER, char_classes

UND = "und"
BUCKETS = 1 << 16
SAMPLE_ROWS = 20_000
#: Rows of a language that are always learned from, however many languages there are.
LEAST_ROWS = 200
#: Texts are counted in pieces of so many characters.
PIECE = 1 << 20
#: Rows that are taken out of an Arrow batch at a time.
PART_ROWS = 256


@functools.cache
def _letters() -> np.ndarray:
    """A letter's own code point, else 0."""
    return np.where(char_classes() == LETTER, np.arange(sys.maxunicode + 1), 0).astype(np.uint32)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's letter trigrams and how often each occurs."""
    total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = text or ""
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        code = _letters()[code]
        keep = code > 0
        keep[:-1] |= keep[1:]  # one blank before each word
        code = np.concatenate([code[keep], np.zeros(1, np.uint32)]).astype(np.uint64)
        if not code.any():
            continue
        if code[0]:
            code = np.concatenate([np.zeros(1, np.uint64), code])
        h = (code[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (code[2:] * np.uint64(0x165667B19E3779F9))
        h = h[code[1:-1] > 0] * np.uint64(0xD6E8FEB86659FD93)
        found = np.unique((h >> np.uint64(48)).astype(np.int64), return_counts=True)
        if total[0].size:
            both = np.bincount(total[0], total[1], BUCKETS) + np.bincount(found[0], found[1], BUCKETS)
            found = np.flatnonzero(both), both[both > 0].astype(np.int64)
        total = found
    return total


def _count(batches):
    """Trigram counts of a task, by language."""
    sums: dict[str, np.ndarray] = {}
    for batch in (b.slice(k, PART_ROWS) for b in batches for k in range(0, b.num_rows, PART_ROWS)):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            bucket, n = trigrams(text)
            if bucket.size:
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[bucket] += n
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])


def row_bound(counts: Sequence[int], sample_rows: int) -> float:
    """Rows of each language at most, so that all languages together have ``sample_rows``."""
    left = sample_rows
    for k, n in enumerate(sorted(counts)):
        if n * (len(counts) - k) > left:
            return max(LEAST_ROWS, left / (len(counts) - k))
        left -= n
    return max(LEAST_ROWS, *counts) if counts else LEAST_ROWS


def sample(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, lang`` of a sample of rows that has every language."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    bound = row_bound(list(counts.values()), sample_rows)
    cuts = [(lang, math.ceil(min(1.0, bound / n) * (1 << 40))) for lang, n in counts.items()]
    cuts = labelled.sparkSession.createDataFrame(cuts, "lang string, cut long")
    picked = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.col("cut")
    return rows.join(F.broadcast(cuts), "lang").where(picked).select("text", "lang")


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities (buckets x languages) from rows of ``doc_id, text, lang``."""
    counts = sample(labelled, sample_rows).mapInArrow(lean(_count), "lang string, bucket int, n long")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    table = np.zeros((BUCKETS, len(langs)))
    number = {x: k for k, x in enumerate(langs)}
    table[found.column("bucket").to_numpy(), [number[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    if langs:
        seen = max(1, int((table.sum(1) > 0).sum()))
        table = (table + 0.5) / (table.sum(0) + 0.5 * 2 * seen)
    return langs, table


def proportions(like: np.ndarray, n: np.ndarray, start: np.ndarray, steps: int = 60, near: float = 1e-4) -> tuple[np.ndarray, float]:
    """EM: mixture proportions of ``like``'s columns and their log-likelihood; n: count of each row."""
    share, total = start, n.sum()
    for _ in range(steps):
        new = share * (like.T @ (n / (like @ share))) / total
        done = np.abs(new - share).max() < near
        share = new
        if done:
            break
    return share, float(n @ np.log(like @ share))


def infer(bucket: np.ndarray, n: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of all languages (0 for those not chosen) and the best one's posterior among single languages."""
    like = table[bucket]
    single = n @ np.log(like)
    best = int(np.argmax(single))
    total = n.sum()
    chosen, share, value = [best], np.ones(1), single[best]
    while len(chosen) < like.shape[1]:
        slope = like.T @ (n / (like[:, chosen] @ share)) / total  # above 1: adding this language can help
        slope[chosen] = 0
        new = int(np.argmax(slope))
        if slope[new] <= 1:
            break
        start = np.append(share * 0.9, 0.1)
        with_new, better = proportions(like[:, [*chosen, new]], n, start)
        if 2 * (better - value) / 3 <= np.log(total):
            break
        chosen, share, value = [*chosen, new], with_new, better
    out = np.zeros(like.shape[1])
    out[chosen] = share
    weight = np.exp((single - single[best]) / 3)
    return out, float(1 / weight.sum())


def annotate(docs: DataFrame, model: tuple[list[str], np.ndarray], prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the language's proportion times
    its posterior) and ``shares`` of all languages in sorted order; columns
    of these names (with ``prefix`` before them) are replaced."""
    langs, table = model
    added = [f"{prefix}{c}" for c in ("lang_pred", "score", "shares")]
    docs = docs.drop(*added)

    def run(batches):
        for batch in (b.slice(k, PART_ROWS) for b in batches for k in range(0, b.num_rows, PART_ROWS)):
            out = []
            for text in batch.column("text").to_pylist():
                bucket, n = trigrams(text)
                if not bucket.size or not langs:
                    out.append((UND, 0.0, [0.0] * len(langs)))
                    continue
                share, sure = infer(bucket, n.astype(np.float64), table)
                k = int(np.argmax(share))
                out.append((langs[k], min(1.0, float(share[k]) * sure), share.tolist()))
            new = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added])

    schema = StructType([*docs.schema.fields, *(StructField(c, t) for c, t in zip(added, (StringType(), DoubleType(), ArrayType(DoubleType()))))])
    return docs.mapInArrow(lean(run), schema)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``doc_id, lang_pred, score, shares`` of every document."""
    return annotate(whole_text(docs), model).drop("text")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out()).select("doc_id", "text", "lang")
