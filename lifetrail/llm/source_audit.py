"""How far the sources of a language differ: an exact audit of their terms.

Terms are runs of letters and characters beyond ASCII; only A-Z are lowered.
A language keeps the terms that occur in at least ``MIN_DOCS`` of its
documents, V in number.  Every (language, source) group and every language
gives each kept term the integer share

    p = 1 + floor(10^9 * (count + 1) / (N + V)),   N the group's kept occurrences

and two distributions differ in a term by ``f = floor((p - q)^2 / q)``.

1. Frequency filter, exact: a pass over the documents counts the documents
   of every (language, term); each task adds up before the shuffle.
2. Minimal perfect hash: a language's kept terms are dealt to shards of
   about ``SHARD_TERMS`` by their hash, and each shard is hashed in its own
   group (``perfect_hash``).
3. Recount: the shards are broadcast, as many at a time as
   ``WAVE_BYTES`` hold (their sizes are summed first; a larger vocabulary
   takes more passes, never a larger broadcast).  Each pass reads the
   documents again and counts terms into dense slots of the groups that a
   task meets; a lookup checks the stored key.  Slots beyond ``TASK_SLOTS``
   are handed on and start anew.
4. Groups' counts are added in the order of their keys, a row at a time, so
   no group of rows is gathered.  Shares and differences are computed
   shard by shard, sources in blocks of ``SOURCES``; what leaves a shard is
   one number for a pair of sources and the best ``TOP`` terms of a group.

Arithmetic is exact: shares come by long division in steps of 1,000 (right
while N + V stays below 9e15), the sums of differences in DECIMAL.

Defined cases: null text, language and source count as empty strings;
repeated rows are documents of their own; a language without kept terms
gives its pairs with value 0 and no terms; a language with one source gives
no pairs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifetrail.llm import perfect_hash
from lifetrail.llm.common import materialise

MIN_DOCS, TOP = 3, 200
SHARD_TERMS = 32_768
#: Packed shards that are broadcast at a time.
WAVE_BYTES = 32 << 20
#: Distinct terms that a task counts, and slots that it holds, before it hands them on.
TASK_TERMS, TASK_SLOTS = 300_000, 4 << 20
#: A group's rows are first added in so many parts, and a language's terms met in so many, so a hot one is the work of several tasks.
PARTS = 32
#: Sources of a language that meet in one group of rows, with as many others.
SOURCES = 16
TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lowered bytes: bytes.lower() lowers A-Z only
COUNTS = "slots binary, counts binary, total long"


def groups_of(docs: DataFrame) -> DataFrame:
    """``lang, source, text`` (bytes) of every document, nulls as empty."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def _document_counts(batches):
    held, size = {}, 0

    def rows():
        for lang, count in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(count), pa.string()), pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["lang", "term", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            count = held.setdefault(lang, Counter())
            size -= len(count)
            count.update(set(TERM.findall(text.as_py().lower())))
            size += len(count)
            if size > TASK_TERMS:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term`` (bytes) of the terms in at least ``min_docs`` documents of a language."""
    found = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term binary, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")


# ---------------------------------------------------------------- perfect hashes
def _build(group: pa.Table) -> pa.Table:
    keys = sorted(group.column("term").to_pylist())
    packed = perfect_hash.build(keys)
    return pa.table({"lang": group.column("lang").slice(0, 1), "shard": group.column("shard").slice(0, 1), "shards": group.column("shards").slice(0, 1),
                     "n": pa.array([len(keys)], pa.int32()), "packed": pa.array([packed], pa.binary())})


def hash_shards(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """``lang, shard, shards, n, packed``: the kept terms' perfect hashes, at least one shard of one term."""
    # a language may hold a third of all terms: its number meets them in ``PARTS`` places
    numbers = kept.groupBy("lang").agg(F.ceil(F.count("*") / shard_terms).cast("int").alias("shards")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = kept.withColumn("salt", F.pmod(F.xxhash64(F.lit(1), "term"), F.lit(PARTS)).cast("int")).join(numbers, ["lang", "salt"]).drop("salt").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    return dealt.groupBy("lang", "shard").applyInArrow(_build, "lang string, shard int, shards int, n int, packed binary")


def waves_of(shards: DataFrame, wave_bytes: int = WAVE_BYTES) -> tuple[DataFrame, int]:
    """``shards`` with ``wave``, and the number of waves: each holds ``wave_bytes`` at most (or one shard)."""
    sized = shards.select("*", F.length("packed").alias("bytes"))
    total = sized.agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).first()
    waves = max(1, -(-(total["b"] or 0) // wave_bytes))
    while True:
        dealt = sized.withColumn("wave", F.pmod(F.xxhash64("lang", "shard"), F.lit(waves)).cast("int"))
        most = dealt.groupBy("wave").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).where("n > 1").agg(F.max("b")).first()[0]
        if (most or 0) <= wave_bytes:
            return dealt, waves
        waves += max(1, waves // 2)


# ---------------------------------------------------------------- recount
def _sparse(counts: np.ndarray) -> tuple[bytes, bytes, int]:
    at = np.flatnonzero(counts)
    return at.astype("<u4").tobytes(), counts[at].astype("<i8").tobytes(), int(counts.sum())


def _dense(slots, counts, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    if slots is not None:
        out[np.frombuffer(slots, "<u4")] = np.frombuffer(counts, "<i8")
    return out


def _recount(held, task_terms: int, task_slots: int):
    """Counts of the broadcast shards' terms, by group: one row each time that a group is handed on.
    A term's place is its shard's number and, in the lower half, its slot."""
    def run(batches):
        vocabulary = {lang: perfect_hash.Shards(total, packed) for lang, (total, packed) in held.value.items()}
        words, size, dense, slots = {}, 0, {}, 0
        part = TaskContext.get().partitionId() % PARTS

        def rows():
            nonlocal dense, slots
            for (lang, source), counts in dense.items():
                base = vocabulary[lang].base
                at = np.flatnonzero(counts)
                shard = np.searchsorted(base, at, side="right") - 1
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([source], pa.string()), pa.array([part], pa.int32()),
                                                      pa.array([(shard << 32 | at - base[shard]).astype("<i8").tobytes()], pa.binary()), pa.array([counts[at].astype("<i8").tobytes()], pa.binary())],
                                                     names=["lang", "source", "part", "places", "counts"])
            dense, slots = {}, 0

        def count():
            nonlocal words, size, slots
            for (lang, source), counter in words.items():
                found = vocabulary[lang].lookup(list(counter))
                at = found >= 0
                if (lang, source) not in dense:
                    dense[lang, source] = np.zeros(vocabulary[lang].slots, np.int64)
                    slots += vocabulary[lang].slots
                dense[lang, source][found[at]] += np.fromiter(counter.values(), np.int64, len(counter))[at]
                if slots > task_slots:
                    yield from rows()
            words, size = {}, 0

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                if lang not in vocabulary:
                    continue
                counter = words.setdefault((lang, source), Counter())
                size -= len(counter)
                counter.update(TERM.findall(text.as_py().lower()))
                size += len(counter)
                if size > task_terms:
                    yield from count()
        yield from count()
        yield from rows()
    return run


def _summed(places: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at, c = np.concatenate(places), np.concatenate(counts)
    order = np.argsort(at, kind="stable")
    at, c = at[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(c, first)


def _by_shard(most: int = 1 << 20):
    """Add up a group's rows, which stand one after the other, and cut them into shards."""
    def run(batches):
        key, places, counts, size = None, [], [], 0

        def rows():
            if places:
                at, c = _summed(places, counts)
                shard = at >> 32
                cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
                parts = list(zip(cut[:-1], cut[1:]))
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.string()), pa.array(shard[cut[:-1]], pa.int32()), pa.array([(at[x:y] & 0xFFFFFFFF).astype("<u4").tobytes() for x, y in parts], pa.binary()),
                     pa.array([c[x:y].tobytes() for x, y in parts], pa.binary())], names=["lang", "source", "shard", "slots", "counts"])

        for batch in batches:
            for *now, at, c in zip(*(batch.column(x).to_pylist() for x in ("lang", "source", "part", "places", "counts"))):
                if now != key:
                    yield from rows()
                    key, places, counts, size = now, [], [], 0
                places.append(np.frombuffer(at, "<i8"))
                counts.append(np.frombuffer(c, "<i8"))
                size += len(places[-1])
                if size > most:
                    at, c = _summed(places, counts)
                    places, counts, size = [at], [c], len(at) // 2
        yield from rows()
    return run


def _add(keys: list[str]):
    """Add up rows that stand one after the other with the same keys."""
    def run(batches):
        held, dense = None, None

        def row():
            slots, counts, total = _sparse(dense)
            return pa.RecordBatch.from_pylist([{**dict(zip(keys, held)), "slots": slots, "counts": counts, "total": total}], schema=out)

        for batch in batches:
            out = pa.schema([*(batch.schema.field(k) for k in keys), ("slots", pa.binary()), ("counts", pa.binary()), ("total", pa.int64())])
            for *key, slots, counts in zip(*(batch.column(c).to_pylist() for c in (*keys, "slots", "counts"))):
                if key != held:
                    if held is not None:
                        yield row()
                    held, dense = key, np.zeros(0, np.int64)
                at = np.frombuffer(slots, "<u4")  # ascending
                if len(at) and at[-1] >= len(dense):
                    dense = np.concatenate([dense, np.zeros(int(at[-1]) + 1 - len(dense), np.int64)])
                dense[at] += np.frombuffer(counts, "<i8")
        if held is not None:
            yield row()
    return run


def _added(rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Counts added by ``keys``: a task reads them in the keys' order, one row at a time."""
    dealt = rows.select(*keys, "slots", "counts").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_add(list(keys)), ", ".join(f"{k} {t}" for k, t in keys.items()) + f", {COUNTS}")


def recount(docs: DataFrame, shards: DataFrame, wave_bytes: int = WAVE_BYTES, task_terms: int = TASK_TERMS, task_slots: int = TASK_SLOTS) -> DataFrame:
    """``lang, source, shard, slots, counts, total``: every group's occurrences of the kept terms."""
    dealt, waves = waves_of(shards, wave_bytes)
    out = None
    for wave in range(waves):
        packed: dict[str, tuple[int, dict[int, bytes]]] = {}
        for r in dealt.where(F.col("wave") == wave).select("lang", "shard", "shards", "packed").toLocalIterator():
            packed.setdefault(r["lang"], (r["shards"], {}))[1][r["shard"]] = bytes(r["packed"])
        held = docs.sparkSession.sparkContext.broadcast(packed)
        part = materialise(docs.mapInArrow(_recount(held, task_terms, task_slots), "lang string, source string, part int, places binary, counts binary"), "audit-counted")
        held.unpersist()
        out = part if out is None else out.unionByName(part)
    group = ("lang", "source", "part")
    shards_of = out.repartition(*group).sortWithinPartitions(*group).mapInArrow(_by_shard(), "lang string, source string, shard int, slots binary, counts binary")
    return _added(shards_of, {"lang": "string", "source": "string", "shard": "int"})


# ---------------------------------------------------------------- shares and differences
def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (n + v)), by long division."""
    whole = np.int64(n + v)
    out, rest = np.divmod(counts + 1, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pairs(group: pa.Table) -> pa.Table:
    """Sums of differences over a shard's terms, of all sources of one block to all of the other and back."""
    rows = group.to_pylist()
    n = max((r["n"] or 0) for r in rows)
    p = np.stack([shares(_dense(r["slots"], r["counts"], n), r["kept"], r["v"]) if n else np.zeros(0, np.int64) for r in rows])
    block = np.array([r["block"] for r in rows])
    same = rows[0]["b1"] == rows[0]["b2"]
    out = []
    for i, r in enumerate(rows):
        others = np.flatnonzero((block != block[i]) | same)
        others = others[others != i]
        value = differences(p[i], p[others]).sum(axis=1)
        out += [(r["source"], rows[j]["source"], int(x)) for j, x in zip(others.tolist(), value.tolist())]
    return pa.table({"lang": pa.array([rows[0]["lang"]] * len(out), pa.string()), "source": pa.array([x[0] for x in out], pa.string()),
                     "item": pa.array([x[1] for x in out], pa.string()), "value": pa.array([x[2] for x in out], pa.int64())})


def _terms(top: int):
    def run(group: pa.Table, lang: pa.Table) -> pa.Table:
        out = []
        if group.num_rows and lang.num_rows:
            whole = lang.to_pylist()[0]
            keys, q = perfect_hash.keys_of(whole["packed"]), None
            for r in group.to_pylist():
                if q is None:
                    q = shares(_dense(whole["slots"], whole["counts"], len(keys)), r["lang_kept"], r["v"])
                at = np.frombuffer(r["slots"], "<u4")
                p = shares(np.frombuffer(r["counts"], "<i8"), r["kept"], r["v"])
                above = p > q[at]
                at, f = at[above], differences(p[above], q[at[above]])
                if len(f) > top:
                    held = f >= np.partition(f, len(f) - top)[len(f) - top]
                    at, f = at[held], f[held]
                best = sorted(((-x, keys[a]) for x, a in zip(f.tolist(), at.tolist())))[:top]
                out += [(r["lang"], r["source"], k, -x) for x, k in best]
        return pa.table({"lang": pa.array([x[0] for x in out], pa.string()), "source": pa.array([x[1] for x in out], pa.string()),
                         "item": pa.array([x[2] for x in out], pa.binary()), "value": pa.array([x[3] for x in out], pa.int64())})
    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard_terms: int = SHARD_TERMS, wave_bytes: int = WAVE_BYTES,
          task_terms: int = TASK_TERMS, task_slots: int = TASK_SLOTS, sources: int = SOURCES) -> DataFrame:
    """``lang, source, part, item, value, rank`` as the module describes."""
    rows = groups_of(docs)
    kept = materialise(kept_terms(rows, min_docs), "audit-terms")
    shards = materialise(hash_shards(kept, shard_terms), "audit-shards")
    counts = materialise(recount(rows, shards, wave_bytes, task_terms, task_slots), "audit-counts")

    # one row for a group: its kept occurrences, its language's, V, and its place among the language's sources
    langs = shards.groupBy("lang").agg(F.sum("n").cast("long").alias("v"), F.max("shards").alias("shards"))
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("kept"))
    known = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    known = known.select("lang", "source", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("shards", F.lit(0)).alias("shards"))
    per_lang = Window.partitionBy("lang")
    info = known.select("*", F.sum("kept").over(per_lang).alias("lang_kept"), F.count("*").over(per_lang).alias("n_sources"),
                        F.floor((F.row_number().over(per_lang.orderBy("source")) - 1) / sources).cast("int").alias("block"))
    info = materialise(info.withColumn("blocks", F.ceil(F.col("n_sources") / sources).cast("int")), "audit-groups")

    dense = info.where("n_sources > 1").withColumn("shard", F.explode(F.sequence(F.lit(0), F.greatest(F.col("shards") - 1, F.lit(0)))))
    dense = dense.join(counts.drop("total"), ["lang", "source", "shard"], "left").join(shards.select("lang", "shard", "n"), ["lang", "shard"], "left")
    met = dense.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("lang", "source", "shard", "kept", "v", "n", "slots", "counts", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    pairs = met.groupBy("lang", "shard", "b1", "b2").applyInArrow(_pairs, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))

    whole = _added(counts, {"lang": "string", "shard": "int"})
    blocks = info.groupBy("lang").agg(F.max("blocks").alias("blocks"))
    right = whole.drop("total").join(shards.select("lang", "shard", "packed"), ["lang", "shard"]).join(blocks, "lang")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = counts.drop("total").join(info.select("lang", "source", "kept", "v", "lang_kept", "block"), ["lang", "source"])
    keys = ("lang", "shard", "block")
    terms = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_terms(top), "lang string, source string, item binary, value long")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = terms.withColumn("item", F.col("item").cast("string")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
